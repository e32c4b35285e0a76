"""Known dictionaries.  Fixed values, in registry order, by which a title finds its first match:
abbreviation | title | English title | colour | category | language | publisher."""

TABLE = """
大辞林4|大辞林 第四版||#2E6DA4|国語辞典|ja|三省堂
大辞泉|デジタル大辞泉||#1A8C5B|国語辞典|ja|小学館
明鏡3|明鏡国語辞典 第三版||#3E8C3A|国語辞典|ja|大修館書店
日国|日本国語大辞典 第二版||#8B1A1A|国語辞典|ja|小学館
三国7|三省堂国語辞典 第七版||#E05C00|国語辞典|ja|三省堂
三国8|三省堂国語辞典 第八版||#C44D00|国語辞典|ja|三省堂
新明解8|新明解国語辞典 第八版||#D4282E|国語辞典|ja|三省堂
漢辞海3|全訳漢辞海 第三版||#7B5C00|漢和辞典|ja|三省堂
漢辞海4|全訳漢辞海 第四版||#996A00|漢和辞典|ja|三省堂
新字源|角川新字源 改訂新版||#5B3A7A|漢和辞典|ja|角川書店
旺古4|旺文社古語辞典 第四版||#6B5B3A|古語辞典|ja|旺文社
旺古5|旺文社古語辞典 第五版||#7D6A42|古語辞典|ja|旺文社
三読古5|三省堂 全訳読解古語辞典 第五版||#4A6B3A|古語辞典|ja|三省堂
角川類語|角川類語新辞典||#9B3A6B|類語辞典|ja|角川書店
シソーラス2|日本語シソーラス 第二版||#6B3A9B|類語辞典|ja|大修館書店
NHKアクセント|NHK日本語発音アクセント新辞典||#C47000|アクセント|ja|NHK出版
漢検2|漢検漢字辞典 第二版||#4A4A8B|漢字|ja|日本漢字能力検定協会
有斐法5|有斐閣 法律用語辞典 第五版||#3A6B5B|専門用語|ja|有斐閣
有斐心|有斐閣 現代心理学辞典||#5B6B3A|専門用語|ja|有斐閣
ACE3|エースクラウン英和辞典||#E8A435|英和・和英|en-ja|三省堂
G5|ジーニアス英和辞典 第5版|Genius English-Japanese Dictionary 5th ed.|#1B7A6E|英和・和英|en-ja|大修館書店
G6|ジーニアス英和辞典 第6版|Genius English-Japanese Dictionary 6th ed.|#1B9A8E|英和・和英|en-ja|大修館書店
KCEJ|研究社 コンパスローズ英和辞典|Compass Rose English-Japanese Dictionary|#C45B28|英和・和英|en-ja|研究社
CCJAD|COBUILD上級英和辞典|COBUILD Advanced Dictionary of American English, English/Japanese|#5B3E8A|英和・和英|en-ja|HarperCollins / 旺文社
KEC|新編 英和活用大辞典|The Kenkyusha Dictionary of English Collocations|#8B4513|英和・和英|en-ja|研究社
KNEJ|研究社 新英和大辞典 第6版|Kenkyusha's New English-Japanese Dictionary 6th ed.|#2C5F8A|英和・和英|en-ja|研究社
KNJE|研究社 新和英大辞典 第5版|Kenkyusha's New Japanese-English Dictionary 5th ed.|#6B2D5B|英和・和英|ja-en|研究社
GDAI|大修館書店 ジーニアス英和大辞典|Taishukan's Unabridged Genius English-Japanese Dictionary|#0D7377|英和・和英|en-ja|大修館書店
GQE|研究社 英語の数量表現辞典 増補改訂版|Kenkyusha's Guide to Quantitative Expressions in English|#7B6B3A|英和・和英|en-ja|研究社
OLEX|旺文社 オーレックス英和辞典 第2版||#D4442E|英和・和英|en-ja|旺文社
Readers|研究社 リーダーズ英和辞典 第3版|Kenkyusha's Readers English-Japanese Dictionary 3rd ed.|#8B1A1A|英和・和英|en-ja|研究社
RHEJ|小学館 ランダムハウス英和大辞典 第2版|Random House English-Japanese Dictionary 2nd ed.|#2E4057|英和・和英|en-ja|小学館
SOEJCD|小学館 オックスフォード英語コロケーション辞典|Shogakukan-Oxford English-Japanese Collocations Dictionary|#4A7C59|英和・和英|en-ja|小学館
SOEJT|小学館 オックスフォード英語類語辞典|Shogakukan-Oxford English-Japanese Learner's Thesaurus|#5C7C4A|英和・和英|en-ja|小学館
WISDOM3|ウィズダム英和辞典 第4版 + 和英辞典 第3版|Wisdom English-Japanese Dictionary 4th ed. + Japanese-English 3rd ed.|#1B3A5C|英和・和英|en-ja|三省堂
"""

ROWS = tuple(tuple(x or None for x in line.split("|")) for line in TABLE.strip().split("\n"))
