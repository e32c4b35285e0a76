"""The built-in part of the pattern catalogue, as plain rows.

Fixed values: markers, pattern names, labels, parts of speech and confidences.  The catalogue is a
parameter (see patterns.load_catalogue); what is built in is a core of about 200 rows that has every
family, some of them whole.
"""

from __future__ import annotations

NOUN, VERB, ADJ_I, ADJ_NA, ADVERB, EXPRESSION, AUX = "名詞", "動詞", "い形容詞", "な形容詞", "副詞", "表現", "助動詞"

#: Expressions with alternatives: family, expression ({N} is a content word), head, collocate, pattern, label,
#: the head's and the collocate's part of speech, confidence.  $1, $2, .. are the expression's groups.
HUMANS = "人間|人|者|存在|タイプ|生き方|世界|感覚|部分"
PERSONS = "人間|人|者|存在|タイプ|生き方|性格|キャラ|気質|人物"
DISTANT = "遠い|程遠い|かけ離れた|離れた|遠ざかった|遠のいた|縁遠い"
NEAR = "近い|近しい|似た|隣接した|親しい|密接な"
EXPRESSIONS = (
    ("比喩照合型", "({N})(みたいな|ような)ところから(遠い|程遠い|かけ離れた|遠ざかった)", "$1", "$2ところから$3", "N+みたいなところから+AdjPred", "比喩距離述語型", NOUN, ADJ_I, 85),
    ("比喩照合型", "({N})(ようなところから)(遠い|程遠い|かけ離れた)", "$1", "$2$3", "N+ようなところから+AdjPred", "比喩距離述語型(文語)", NOUN, ADJ_I, 82),
    ("比喩照合型", "({N})(みたいな|みたいに|みたく)({N})", "$1", "$2$3", "N+みたいな+N", "比喩連体型", NOUN, EXPRESSION, 70),
    ("比喩照合型", "({N})(ような|ようで|ようなもの)({N})", "$1", "$2$3", "N+ような+N", "比喩連体型(文語)", NOUN, EXPRESSION, 65),
    ("比喩照合型", "({N})(らしい|らしく|らしさ|らしかった)", "$1", "$2", "N+らしい", "典型性述語型", NOUN, ADJ_I, 65),
    ("比喩照合型", "({N})(らしくない|らしくなかった|らしくもない)", "$1", "$2", "N+らしくない", "非典型述語型", NOUN, ADJ_I, 70),
    ("比喩照合型", "({N})(っぽい|っぽく|っぽさ|っぽかった)", "$1", "$2", "N+っぽい", "類似性述語型", NOUN, ADJ_I, 70),
    ("比喩照合型", "(まるで)({N})(かのような|かのように|かのごとく)", "$2", "$3", "まるで+N+かのような", "直喩照合型", NOUN, EXPRESSION, 85),
    ("比喩照合型", "({N})(くさい|くさく|くさそう|くさかった)", "$1", "$2", "N+くさい", "臭い比喩型", NOUN, ADJ_I, 65),
    ("比喩照合型", "({N})(のような|みたいな)(人間|人|者|存在|気持ち|感じ|雰囲気)", "$1", "$2$3", "N+のような+人N", "比喩人物型", NOUN, EXPRESSION, 72),
    ("比喩照合型", "({N})(に似た|に似ている|に似てきた)({N})?", "$1", "$2$3", "N+に似た+N", "類似連体型", NOUN, EXPRESSION, 68),
    ("比喩照合型", "({N})(に等しい|に等しかった|も同然の?)", "$1", "$2", "N+に等しい", "同等述語型", NOUN, ADJ_I, 75),
    ("比喩照合型", "({N})(とも言える|とも言えなくもない|とも言えた)", "$1", "$2", "N+とも言える", "同定可能型", EXPRESSION, VERB, 72),
    ("比喩照合型", "({N})(のごとく|のごとき|のごとし)", "$1", "$2", "N+のごとく", "古文直喩型", NOUN, EXPRESSION, 75),
    ("比喩照合型", "({N})(のように|みたいに)(見える|思える|感じる|聞こえる|見えた|感じた)", "$1", "$2$3", "N+のように+感覚V", "比喩感覚型", NOUN, VERB, 75),
    ("比喩照合型", "({N})(めいた|じみた|めく)({N})?", "$1", "$2$3", "N+めいた+N", "擬似属性型", NOUN, EXPRESSION, 68),
    ("比喩照合型", "({N})(ならではの|ならではない)({N})?", "$1", "$2$3", "N+ならではの+N", "固有性型", NOUN, EXPRESSION, 78),
    ("比喩照合型", "({N})(とは一味違う|とは一線を画す|と一線を画す)", "$1", "$2", "N+とは一味違う", "独自性型", NOUN, VERB, 75),
    ("比喩照合型", "({N})(を彷彿とさせる|を思わせる|を連想させる)({N})?", "$1", "$2$3", "N+を彷彿とさせる", "連想喚起型", NOUN, VERB, 78),
    ("比喩照合型", "({N})(ばりの|ばり)({N})?", "$1", "$2$3", "N+ばりの+N", "口語比喩型", NOUN, EXPRESSION, 65),
    ("比喩照合型", "({N})(さながら|さながらに)({N})?", "$1", "$2$3", "N+さながら", "文語直喩型", NOUN, EXPRESSION, 75),
    ("比喩照合型", "({N})(もどき|もどきの)({N})?", "$1", "$2", "N+もどき", "偽似型", NOUN, NOUN, 65),
    ("比喩照合型", "({N})(ような気がする|ような気がした|みたいな気がする)", "$1", "$2", "N+ような気がする", "不確か比喩感覚型", EXPRESSION, EXPRESSION, 72),
    ("比喩照合型", "({N})(かのようだ|かのようである|かのように見える)", "$1", "$2", "N+かのようだ", "直喩断定型", NOUN, EXPRESSION, 78),
    ("比喩照合型", "({N})(顔負けの|顔負けな)({N})?", "$1", "$2$3", "N+顔負けの+N", "凌駕比喩型", NOUN, EXPRESSION, 70),
    ("比喩照合型", "({N})(とは似ても似つかない|と似ても似つかない)", "$1", "$2", "N+とは似ても似つかない", "非類似強調型", NOUN, EXPRESSION, 80),
    ("比喩照合型", "({N})(に通じる|に通じるもの|に通じる部分)(がある|がある)?", "$1", "$2", "N+に通じるもの", "共通性述語型", NOUN, VERB, 68),
    ("比喩照合型", "({N})(みたいな|ような)ところがある", "$1", "$2ところがある", "N+みたいなところがある", "部分比喩型", NOUN, EXPRESSION, 72),
    ("比喩照合型", "({N})的(な|の)(要素|側面|部分|雰囲気|性格|側|面)(がある|もある)?", "$1", "的$2$3", "N+的な+要素N", "的類似型", NOUN, ADJ_NA, 65),
    ("比喩照合型", "({N})(のような|みたいな)(雰囲気|感じ|印象|空気|感覚)(がある|がした)?", "$1", "$2$3", "N+のような+雰囲気N", "雰囲気類似型", NOUN, NOUN, 65),
    ("距離近接述語型", f"({{N}})から({DISTANT})({HUMANS})?", "$1", "から$2$3", "N+から+遠い(N)", "距離述語型", NOUN, ADJ_I, 80),
    ("距離近接述語型", f"({{N}})に({NEAR})(もの|人|感じ|印象|存在)?", "$1", "に$2$3", "N+に+近い(N)", "近接述語型", NOUN, ADJ_I, 75),
    ("距離近接述語型", "({N})とは(程遠い|かけ離れた|似ても似つかない|全く違う|正反対の?)", "$1", "とは$2", "N+とは+程遠い", "対比距離型", NOUN, ADJ_I, 85),
    ("距離近接述語型", f"({{N}})には(縁遠い|縁がない|縁のない|縁もゆかりもない)({HUMANS})?", "$1", "には$2$3", "N+には+縁遠い", "無縁述語型", NOUN, ADJ_I, 80),
    ("距離近接述語型", "({N})とは(無縁の|無縁な|無縁である|無縁だ)", "$1", "とは$2", "N+とは+無縁の", "無縁対比型", NOUN, ADJ_NA, 80),
    ("距離近接述語型", "({N})から(離れた|離れている|離れてしまった|離れ気味の|離れつつある)", "$1", "から$2", "N+から+離れた", "分離述語型", NOUN, VERB, 70),
    ("距離近接述語型", "({N})とは(かけ離れた|かけ離れている|かけ離れてしまっている)", "$1", "とは$2", "N+とは+かけ離れた", "乖離述語型", NOUN, ADJ_I, 82),
    ("距離近接述語型", "({N})と(対極にある|対極に位置する|正反対にある)", "$1", "と$2", "N+と対極にある", "対極述語型", NOUN, VERB, 82),
    ("距離近接述語型", "({N})とは(無関係の|無関係な|関係のない|関係ない)", "$1", "とは$2", "N+とは無関係の", "無関係述語型", NOUN, ADJ_NA, 75),
    ("距離近接述語型", "({N})から(完全に|すっかり|すっかりと)(離れた|離れている|遠ざかった)", "$1", "から$2$3", "N+から+完全に離れた", "完全分離型", NOUN, VERB, 72),
    ("距離近接述語型", "({N})に(ほど遠い|ほど遠かった|まだ遠い|遠く及ばない)", "$1", "に$2", "N+に+ほど遠い", "不足距離型", NOUN, ADJ_I, 78),
    ("距離近接述語型", "({N})から遠い(場所|ところ|世界|領域|分野)(に|で|の)?", "$1", "から遠い$2", "N+から遠い+場所N", "距離場所型", NOUN, ADJ_I, 78),
    ("距離近接述語型", f"({{N}})に(縁遠い|縁がない|縁のない)({HUMANS})?", "$1", "に$2$3", "N+に+縁遠い", "近縁否定型", NOUN, ADJ_I, 75),
    ("距離近接述語型", "({N})と(別世界の|別の世界の|全く別の世界の?)", "$1", "と$2", "N+と別世界の", "別世界述語型", NOUN, EXPRESSION, 72),
    ("距離近接述語型", "({N})から(隔たった|隔絶された|遮断された|切り離された)", "$1", "から$2", "N+から+隔たった", "隔絶述語型", NOUN, VERB, 72),
    ("社会役割型", f"({{N}})から(遠い|程遠い|かけ離れた)({PERSONS})", "$1", "から$2$3", "N+から+遠い+人N", "距離人物型", NOUN, ADJ_I, 85),
    ("社会役割型", f"({{N}})とは(程遠い|かけ離れた)({PERSONS})?", "$1", "とは$2$3", "N+とは+程遠い+人N", "対比距離人物型", NOUN, ADJ_I, 85),
    ("社会役割型", f"({{N}})系(の)?({PERSONS})", "$1", "系$2$3", "N+系の+人N", "属性人物型", NOUN, NOUN, 75),
    ("社会役割型", f"({{N}})(向きの|向けの|向き|向け)({PERSONS})?", "$1", "$2$3", "N+向きの+人N", "適性人物型", NOUN, NOUN, 70),
    ("社会役割型", f"({{N}})肌(の)?({PERSONS})?", "$1", "肌$2$3", "N+肌の+人N", "気質人物型", NOUN, NOUN, 70),
    ("社会役割型", f"({{N}})型(の)?({PERSONS})?", "$1", "型$2$3", "N+型の+人N", "類型人物型", NOUN, NOUN, 70),
    ("社会役割型", f"({{N}})には(縁遠い|縁のない|縁がない)({PERSONS})?", "$1", "には$2$3", "N+には縁遠い+人N", "無縁人物型", NOUN, ADJ_I, 80),
    ("社会役割型", f"({{N}})とは(無縁の|無縁な)({PERSONS})?", "$1", "とは$2$3", "N+とは無縁の+存在N", "無縁人物対比型", NOUN, ADJ_NA, 80),
    ("社会役割型", f"({{N}})的(な|の)({PERSONS})", "$1", "的$2$3", "N+的な+人N", "的属性人物型", NOUN, ADJ_NA, 70),
    ("社会役割型", f"({{N}})(より|寄り)(の)?({PERSONS})?", "$1", "$2$3$4", "N+よりの+人N", "傾向人物型", NOUN, NOUN, 68),
    ("社会役割型", "({N})から(遠い|程遠い|かけ離れた)(生き方|考え方|在り方|スタイル|あり方)", "$1", "から$2$3", "N+から遠い+生き方N", "距離生活型", NOUN, ADJ_I, 80),
    ("擬態語述語型", r"([ぁ-ゖァ-ヶ]{1,4})\1(する|した|しない|な|の|と|で|だ|になる|としている)", "$1$1", "$2", "OnomPred+する", "擬態語述語型", ADVERB, VERB, 75),
    ("擬態語述語型", "(どんどん|ぐんぐん|みるみる|じわじわ|ずんずん|さくさく|ぐるぐる|ぎりぎり|ぼんぼん)({W}{1,10}[うくぐすつぬぶむる])", "$1", "$2", "速度擬態語+V", "速度擬態語動詞型", ADVERB, VERB, 75),
    ("擬態語述語型", "(ぼんやり|ぼーっ|じっと|ふわふわ|のんびり|ゆっくり|しっかり|はっきり|じっくり|ぎっしり|たっぷり|すっきり|さっぱり|うっかり|ぼーっと)(と)?(する|している|見る|考える|待つ|眺める|座る|立っている)?", "$1", "$2$3", "静態擬態語+V", "静態擬態語述語型", ADVERB, VERB, 70),
    ("擬態語述語型", "(ドキドキ|ワクワク|ソワソワ|イライラ|モヤモヤ|ガクガク|ブルブル|ハラハラ|ドキッと|ワクッと)(する|した|している|してしまう)", "$1", "$2", "感情擬態語+する", "感情擬態語述語型", ADVERB, VERB, 78),
)

#: Compound postpositions: postposition, its attributive form, label, confidence.
POSTPOSITIONS = (
    ("について", "についての", "主題後置詞型", 70),
    ("に関して", "に関する", "関係後置詞型", 75),
    ("に対して", "に対する", "対象後置詞型", 75),
    ("にとって", "にとっての", "視点後置詞型", 80),
    ("によって", "による", "手段因果後置詞型", 75),
    ("をめぐって", "をめぐる", "論点後置詞型", 75),
    ("を通じて", "を通じた", "媒介後置詞型", 75),
    ("を通して", "を通した", "媒介後置詞型2", 72),
    ("を介して", "を介した", "仲介後置詞型", 72),
    ("に基づいて", "に基づいた", "根拠後置詞型", 80),
    ("に応じて", "に応じた", "対応後置詞型", 75),
    ("にわたって", "にわたる", "範囲後置詞型", 75),
    ("に際して", "に際した", "機会後置詞型", 75),
    ("に沿って", "に沿った", "随伴方向型", 75),
    ("に向けて", "に向けた", "方向目標型", 75),
    ("に伴って", "に伴う", "随伴因果型", 80),
    ("に続いて", "に続く", "継続時間型", 72),
    ("に先立って", "に先立つ", "先行時間型", 78),
    ("に照らして", "に照らした", "照合型", 75),
    ("に鑑みて", "に鑑みた", "参照考慮型", 78),
    ("を受けて", "を受けての", "応答後置詞型", 75),
    ("を経て", "を経た", "経過後置詞型", 80),
    ("をきっかけに", "をきっかけとした", "契機因果型", 85),
    ("を契機に", "を契機とした", "契機因果型2", 83),
    ("をもとに", "をもとにした", "根拠型", 80),
    ("をはじめ", "をはじめとした", "例示列挙型", 80),
    ("を踏まえて", "を踏まえた", "考慮型", 80),
    ("のもとで", "のもとでの", "条件下型", 75),
    ("において", "における", "場所範囲型", 78),
    ("を超えて", "を超えた", "超越型", 72),
)

#: Markers behind a head: marker, pattern, label, confidence; by the family's name, its head ({S} is a stem of 2 to 12
#: characters, {M} of 2 to 14), and the parts of speech of head and collocate.
MARKERS = (
    ("複合動詞型", "({S})", VERB, VERB, (
        ("始める", "V+始める", "開始アスペクト", 68), ("始めた", "V+始めた", "開始アスペクト(過去)", 68),
        ("出す", "V+出す", "突発アスペクト", 68), ("出した", "V+出した", "突発アスペクト(過去)", 68),
        ("続ける", "V+続ける", "継続アスペクト", 68), ("続けた", "V+続けた", "継続アスペクト(過去)", 68),
        ("終わる", "V+終わる", "完了アスペクト", 68), ("終わった", "V+終わった", "完了アスペクト(過去)", 68),
        ("込む", "V+込む", "深化アスペクト", 68), ("込んだ", "V+込んだ", "深化アスペクト(過去)", 68),
        ("直す", "V+直す", "再行アスペクト", 68), ("直した", "V+直した", "再行アスペクト(過去)", 68),
        ("てくる", "V+てくる", "接近アスペクト", 65), ("ていく", "V+ていく", "離遠アスペクト", 65),
        ("てしまう", "V+てしまう", "完了/後悔アスペクト", 65), ("てしまった", "V+てしまった", "完了/後悔(過去)", 65),
        ("ておく", "V+ておく", "準備アスペクト", 65), ("てある", "V+てある", "結果状態アスペクト", 65), ("てみる", "V+てみる", "試行アスペクト", 65),
    )),
    ("複合動詞型", "({M})", VERB, AUX, (
        ("ことができる", "V+ことができる", "可能型", 75), ("ことができない", "V+ことができない", "不可能型", 75),
        ("ようになる", "V+ようになる", "変化可能型", 75), ("ようになった", "V+ようになった", "変化可能(過去)型", 75),
        ("ことがある", "V+ことがある", "経験型", 75), ("かもしれない", "V+かもしれない", "推量型", 75), ("なければならない", "V+なければならない", "義務型2", 75),
    )),
    ("否定制限型", "({N})", VERB, EXPRESSION, (
        ("わけにはいかない", "V+わけにはいかない", "義務否定型", 85), ("わけではない", "N/V+わけではない", "部分否定型", 78),
        ("はずがない", "V+はずがない", "期待否定型", 80), ("ざるを得ない", "V+ざるを得ない", "強制不可避型", 85),
        ("に違いない", "N/V+に違いない", "強い推量型", 85), ("とは思えない", "N+とは思えない", "認識否定型", 80),
        ("を問わず", "N+を問わず", "無差別制限型", 85), ("にもかかわらず", "N+にもかかわらず", "逆接制限型", 85), ("どころか", "N+どころか", "極端逆接型", 85),
    )),
    ("慣用複合型", "({N})", NOUN, EXPRESSION, (
        ("とはいえ", "N+とはいえ", "譲歩逆接型", 82), ("はともかく", "N+はともかく", "保留限定型", 82), ("もさることながら", "N+もさることながら", "当然追加型", 82),
        ("ばかりか", "N+ばかりか", "累積型", 80), ("のみならず", "N+のみならず", "累積型(文語)", 80), ("だけでなく", "N+だけでなく", "追加型", 78),
        ("に限らず", "N+に限らず", "範囲超越型", 78), ("にしては", "N+にしては", "基準逸脱型", 75),
    )),
    ("形容述語型", "({S})", VERB, ADJ_I, (
        ("やすい", "V+やすい", "容易複合形容型", 75), ("にくい", "V+にくい", "困難複合形容型", 75), ("づらい", "V+づらい", "困難複合形容型2", 73), ("がたい", "V+がたい", "困難複合形容型3", 73),
        ("がちな", "V+がちな", "傾向複合形容型", 75), ("すぎる", "V/Adj+すぎる", "過度型", 72), ("そうな", "V/Adj+そうな", "様態連体型", 70), ("できるだけ", "V+できるだけ", "最大限型", 72),
    )),
    ("様態推量型", "({N})", EXPRESSION, AUX, (
        ("ように見える", "V+ように見える", "外観推量型", 75), ("ように思える", "V+ように思える", "思考推量型", 75), ("と思われる", "V+と思われる", "第三者推量型", 75), ("と考えられる", "V+と考えられる", "論理推量型", 75),
        ("だろう", "V+だろう", "推量型", 65), ("でしょう", "V+でしょう", "推量型(丁寧)", 65), ("可能性がある", "N/V+可能性がある", "可能性型", 75), ("おそれがある", "N/V+おそれがある", "危惧可能性型", 78),
    )),
    ("時間因果型", "({N})", NOUN, EXPRESSION, (
        ("をきっかけに", "N+をきっかけに", "契機型", 85), ("を機に", "N+を機に", "機会型", 80), ("を経て", "N+を経て", "経過型", 80), ("の結果", "N+の結果", "結果型", 80),
        ("と同時に", "N+と同時に", "同時型", 75), ("たびに", "N+たびに", "反復型", 75), ("ために", "N+ために(原因)", "原因型", 72), ("が原因で", "N+が原因で", "原因型2", 75),
    )),
    ("対比関係型", "({N})", NOUN, EXPRESSION, (
        ("に比べて", "N+に比べて", "比較型", 80), ("と比べて", "N+と比べて", "比較型2", 78), ("とは違って", "N+とは違って", "相違型", 80), ("とは異なり", "N+とは異なり", "相違型3", 78),
        ("に反して", "N+に反して", "逆接型", 78), ("の代わりに", "N+の代わりに", "代替型3", 75), ("ではなく", "N+ではなく", "否定置換型2", 72), ("と裏腹に", "N+と裏腹に", "裏腹型", 78),
    )),
    ("空間方向型", "({N})", NOUN, VERB, (
        ("に向けて", "N+に向けて", "方向型", 75), ("に向かって", "N+に向かって", "方向型2", 75), ("を目指して", "N+を目指して", "目標型", 80), ("を中心に", "N+を中心に", "中心型", 80),
        ("を取り巻く", "N+を取り巻く", "周囲型", 72), ("に沿って", "N+に沿って", "随伴方向型", 75), ("に至るまで", "N+に至るまで", "到達範囲型", 80), ("を超えて", "N+を超えて", "超越型", 72),
    )),
    ("条件仮定型", "({N})", VERB, AUX, (
        ("なければならない", "V+なければならない", "義務条件型", 80), ("なくてはならない", "V+なくてはならない", "義務条件型3", 80), ("ないといけない", "V+ないといけない", "義務条件型5", 78), ("ためには", "V+ためには", "目的条件型", 75),
        ("かぎり", "V+かぎり", "条件限定型", 72), ("としたら", "V+としたら", "仮定型", 70), ("とすれば", "V+とすれば", "仮定型2", 70), ("さえあれば", "N+さえあれば", "存在条件型", 75),
    )),
    ("引用照合型", "({N})", EXPRESSION, VERB, (
        ("と言われる", "N+と言われる", "呼称引用型", 70), ("と言われている", "N+と言われている", "通説引用型", 73), ("と呼ばれる", "N+と呼ばれる", "名称引用型", 72), ("として知られる", "N+として知られる", "著名引用型", 75),
        ("という印象", "N+という印象", "印象引用型", 70), ("という感じ", "N+という感じ", "感覚引用型", 68), ("とは何か", "N+とは何か", "定義疑問型", 72), ("というもの", "N+というもの", "定義的表現型", 65),
    )),
    ("数量程度型", "({N})", NOUN, EXPRESSION, (
        ("ほど", "N+ほど", "程度比較型", 68), ("ほどの", "N+ほどの", "程度連体型", 68), ("くらい", "N+くらい", "おおよそ程度型", 65), ("程度の", "N+程度の", "程度連体型2", 65),
        ("だけの", "N+だけの", "相応連体型", 65), ("にわたって", "N+にわたって", "範囲型", 75), ("以上の", "N+以上の", "超過連体型", 68), ("に及ぶ", "N+に及ぶ", "到達型", 70),
    )),
    ("目的原因型", "({N})", NOUN, EXPRESSION, (
        ("のために", "N+のために", "目的型", 73), ("が目的で", "N+が目的で", "目的型2", 73), ("を目的として", "N+を目的として", "目的型3", 75), ("のせいで", "N+のせいで", "責任原因型", 72),
        ("のおかげで", "N+のおかげで", "恩恵型", 73), ("だから", "N+だから", "口語原因型", 65), ("からこそ", "N+からこそ", "強調原因型", 75), ("ことから", "V+ことから", "根拠型", 70),
    )),
)

#: Body idioms: part of the body, what follows its が, label.
BODY_IDIOMS = (
    ("気", ("付く", "向く", "乗る", "引ける", "遠くなる", "重い", "楽になる", "変わる", "つく", "する", "合う", "済む", "進む", "強い", "弱い", "散る", "小さい", "多い"), "気イディオム型"),
    ("手", ("届く", "届かない", "離せない", "かかる", "足りない", "いい", "伸びる", "震える", "空く", "塞がる", "込む", "入れる"), "手イディオム型"),
    ("目", ("覚める", "開く", "離せない", "眩む", "輝く", "見えない", "細くなる", "丸くなる", "充血する", "潤む", "が赤い"), "目イディオム型"),
    ("心", ("動く", "痛む", "折れる", "弾む", "通じる", "和む", "乱れる", "揺れる", "癒される", "締め付けられる"), "心イディオム型"),
    ("胸", ("痛む", "躍る", "詰まる", "締め付けられる", "ざわつく", "が熱くなる"), "胸イディオム型"),
)
