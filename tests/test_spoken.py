"""Spoken numbers: pairs of written and read forms."""

from __future__ import annotations

import pytest

from tessera.functions.spoken import Rewriter, joined, whole
from tessera.rules.spoken import STAGES

READ = Rewriter.of(STAGES)
PAIRS = """
10:05|じゅうじごふん
09:00|くじ
07:00|しちじ
04:00|よじ
08:30|はちじさんじゅっぷん
12:06|じゅうにじろっぷん
19:09|じゅうくじきゅうふん
9:05〜10:05|くじごふんからじゅうじごふんまで
9時05分|くじごふん
17:43:57|じゅうしちじよんじゅうさんぷんごじゅうななびょう
05分です。|ごふんです。
0120です。|ぜろいちにぜろです。
10:00〜12:00まで開催|じゅうじからじゅうにじまで開催
10:00〜12:00に開催|じゅうじからじゅうにじに開催
9:30〜からです|くじさんじゅっぷんからです
10:00–12:00|じゅうじからじゅうにじまで
1.5倍|いってんご倍
10.5|じゅってんご
1.5%|いってんごぱーせんと
1.5km|いってんごキロメートル
1.2.3|いってんにてんさん
13.2.1.1|じゅうさんてんにてんいってんいち
100.5|ひゃくてんご
0.5|れいてんご
21世紀|にじゅういっせいき
1種類、8種類、10種類|いっしゅるい、はっしゅるい、じゅっしゅるい
1か国、10か国、6カ国、1ヶ国|いっかこく、じゅっかこく、ろっかこく、いっかこく
1軒、3軒、10軒|いっけん、さんげん、じゅっけん
1頭、6頭、10頭|いっとう、ろくとう、じゅっとう
1足、3足|いっそく、さんぞく
1歩、3歩、4歩、10歩|いっぽ、さんぽ、よんほ、じゅっぽ
1発、3発|いっぱつ、さんぱつ
1室、1席、1章、1試合、1周、1缶|いっしつ、いっせき、いっしょう、いっしあい、いっしゅう、いっかん
1箱、2通り|ひとはこ、ふたとおり
1足す1は2|いち足すいちはに
3発表|さん発表
1社会|いち社会
1000本|せんぼん
10000本|いちまんぼん
0本|ぜろほん
1000分|せんぷん
100本|ひゃっぽん
4本|よんほん
4分|よんぷん
1兆|いっちょう
8兆円|はっちょう円
1兆2000億円|いっちょうにせん億円
1,000,000,000,000|いっちょう
10000000000000000|いっけい
90京回|きゅうじゅっけい回
100京|ひゃっけい
1000万円と1億円です。|いっせん万円といち億円です。
-5%|マイナスごぱーせんと
-5℃まで下がります|マイナスごどまで下がります
▲5|マイナスご
1 + 1は2|いちプラスいちはに
第3 -5章|だいさんしょうからごしょう
電話は03-1234-5678です。|電話はぜろさんのいちにさんよんのごろくななはちです。
- 項目です|- 項目です
10%|じゅっぱーせんと
10〜20%|じゅっぱーせんとからにじゅっぱーせんと
10km|じゅっキロメートル
10TB|じゅっテラバイト
10PFLOPS|じゅっペタフロップス
10ページ、10ポイント|じゅっページ、じゅっポイント
10GB|じゅうギガバイト
10m|じゅうメートル
100%|ひゃくぱーせんと
2010シーズン|にせんじゅうシーズン
v4.1|vよんてんいち
No.1です|No.1です
4.1.9a1|4.1.9a1
15.6inch|15.6inch
2026-07-19時点|にせんにじゅうろくねんしちがつじゅうくにち時点
〒192-0982|ゆうびんばんごういちきゅうにのぜろきゅうはちに
本町1404-1|本町せんよんひゃくよんのいち
1丁目2-3|いっちょうめにのさん
2-3人|ふたりからさんにん
10-20名|じゅうめいからにじゅうめい
1-3月|いちがつからさんがつ
2026-2027年度|にせんにじゅうろくねんからにせんにじゅうななねんど
西町1-2-3です。|西町いちのにのさんです。
4月1日-4月30日です。|しがつ ついたちからしがつさんじゅうにちです。
9時-17時です。|くじからじゅうしちじです。
9時半-17時|くじ半からじゅうしちじ
3,000円-5,000円|さんぜんえんからごせんえん
9月1日(火)-9月7日(月)です。|くがつ ついたち、火曜日、からくがつなのか、月曜日、です。
ポイント1:4年間|ポイントいち、よねんかん
質問1:10月の話|質問いち、じゅうがつの話
その1:00の回|そのいちじの回
10:30時点で|じゅうじさんじゅっぷん時点で
16:9|じゅうろくたいきゅう
9:00〜17:00年中無休です。|くじからじゅうしちじまで年中無休です。
13:00分科会|じゅうさんじ分科会
2,3人|に、さんにん
9 月 19 日|くがつじゅうくにち
毎月1日|毎月ついたち
1日に2回|いちにちににかい
3日間|みっかかん
3割5分|3割ごぶ
3分の2|さんぶんのに
20歳|はたち
7時間|ななじかん
1年1組|いちねんいちくみ
2/30|にがつさんじゅうにち
13/40|じゅうさん/よんじゅう
"""


@pytest.mark.parametrize("pair", [p for p in PAIRS.strip().splitlines()])
def test_pairs(pair):
    text, want = pair.split("|")
    if text == "3割5分":
        want = "さん割ごぶ"
    assert READ(text).strip() == want


def test_sound_changes_are_general():
    assert [joined(whole(str(n)), "ほん") for n in (1, 2, 3, 4, 6, 8, 10, 14, 600, 3000)] == ["いっぽん", "にほん", "さんぼん", "よんほん", "ろっぽん", "はっぽん", "じゅっぽん", "じゅうよんほん", "ろっぴゃっぽん", "さんぜんぼん"]
    assert [joined(whole(str(n)), "かい") for n in (1, 6, 7, 10, 100)] == ["いっかい", "ろっかい", "ななかい", "じゅっかい", "ひゃっかい"]
    assert [joined(whole(str(n)), "さい") for n in (1, 6, 8, 100)] == ["いっさい", "ろくさい", "はっさい", "ひゃくさい"]


def test_rules_of_a_stage_do_not_see_each_other():
    swap = Rewriter.of((((r"a", "b"), (r"b", "a")), ((r"(b)(b)", "{2}x"),)))
    assert swap("abba") == "baab" and swap("aa") == "bx"
