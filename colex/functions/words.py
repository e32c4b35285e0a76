"""Word lists and rewrite tables of the classifier.  Fixed values, in their order."""

NA_ADJECTIVES = (
    "静か 大切 不思議 必要 大丈夫 簡単 重要 有名 大変 元気 丁寧 親切 便利 複雑 特別 普通 自由 安全 危険 適当 十分 微妙 明確 曖昧 劇的 急激 中途半端 的 素直 上手 "
    "下手 好き 嫌い 得意 苦手 大好き 完全 正確 暖か 賑やか 穏やか 豊か 愉快 不愉快 綺麗 きれい 素敵 素晴らし ハンサム 親密 重大 深刻 緊急 高度 精密 高尚 幸福 幸せ "
    "不幸 残念 可能 不可能 明らか 確か 不確か 当然 自然 不自然 真剣 真面目 不真面目 積極的 消極的 具体的 抽象的 一般的 特定 多様 均一 同様 異様 合法 違法 有効 無効 "
    "適切 不適切 合理的 非合理的 理想的 現実的 論理的 感情的 客観的 主観的 相対的 絶対的 基本的 応用的 専門的 技術的 歴史的 伝統的 革新的 典型的 例外的 公式 非公式 "
    "正式 平和 安定 不安定 健康 不健康 清潔 不潔 快適 不快"
).split()
SURU_VERBS = (
    "勉強 研究 調査 批判 発達 発展 発生 発見 発明 発表 説明 確認 確保 確立 対応 対策 対象 検討 検査 検証 分析 分類 分解 理解 解決 解説 解釈 記録 記述 記憶 整理 整備 "
    "整合 比較 比喩 参考 参照 参加 判断 判明 判定 評価 評論 表現 表示 表記 報告 報道 通報 実施 実行 実現 実験 実感 設定 設立 設置 設計 管理 監視 監督 修正 修理 修了 "
    "完成 完了 開始 開発 利用 活用 活動 使用 操作 制御 制作 制限 製作 製造 反映 反応 反省 反対 賛成 主張 主導 強調 強制 支援 支持 支配 指摘 指示 指導 紹介 提供 提案 "
    "提示 要求 要望 要約 準備 予定 予測 予防 防止 防衛 保護 保証 保存 保管 維持 運営 運用 採用 採取 収集 収録 注目 注意 集中 集計 観察 観測 体験 経験 調整 調節 転換 "
    "変換 変更 変化 進化 進行 進歩 促進 推進 普及 拡大 縮小 増加 減少 向上 改善 改革 推薦 引用 批評 否定 肯定 承認 消費 生産 流通 販売 購入 投資 貯蓄 融資 損失 利益 "
    "計算 測定 評定 競争 協力 協議 協調 統合 連携 連絡 接続 切断 分離 合併 統一"
).split()
COLLOQUIAL_FORMS = (
    ("てる", "ている"), ("でる", "でいる"), ("ってた", "と言っていた"), ("てた", "ていた"), ("でた", "でいた"), ("じゃ", "では"), ("んだ", "のだ"), ("んです", "のです"),
    ("っぽい", "らしい"), ("やっぱ(?!り)", "やはり"), ("やっぱり", "やはり"), ("ちょっと", "少し"), ("すごい", "とても"), ("めっちゃ", "とても"), ("超([^\\s　])", "とても$1"),
)
HONORIFIC = "いらっしゃる おっしゃる なさる ございます いただく くださる 申し上げる 伺う 拝見 ご覧 お〜になる 〜られる".split()
SLANG = "ボロカス パチ やばい やべ ムカつく ウザい キモい ダサい イケてる ウケる チョベリバ ぱちこく パチこく".split()
DIALECT = "パチこく パチこいてる 〜へん 〜やん 〜やろ 〜ちゃう 〜やな 〜はる 〜でんがな 〜どす 〜ずら 〜べ 〜だべ 〜じゃ".split()
ACADEMIC = (
    "文法 品詞 テンス アスペクト 形態素 語彙 語用 意味 音韻 統語 談話 コーパス 分析 研究 論文 仮説 批判 記述 調査 言語学 言語 引用 標準 規則 規範 体系 データ 理論 "
    "モデル フレーム スキーマ 構造 特徴 機能 分類 類型 比較 対照 歴史 変化 発達 習得 教授"
).split()
LINGUISTIC = "言語 文法 語彙 品詞 テンス アスペクト".split()
BODY = "手 目 足 顔 頭 心 体 耳 口 鼻 肩 腕 背 胸 腹 腰 指 爪 歯 舌 唇 眉 ひげ 髪".split()
EMOTION = "気 心 感 喜 悲 怒 恐 愛 嫌 好 楽 辛 苦 嬉しい 悲しい 怒る 怖い 愛する 嫌い 好き 楽しい 辛い 苦しい 寂しい 恥ずかしい 驚く 感動 感謝 後悔".split()
ADVERBS = (
    "じっくり はっきり ゆっくり しっかり ぎっしり ざっくり さっぱり すっきり たっぷり びっくり ふっくら ぼんやり まったり のんびり きっぱり てっきり うっかり ちゃっかり "
    "じっと ぼーっと ぼんやりと はっと ふと すっと もっと ずっと きっと もともと たとえば"
).split()
