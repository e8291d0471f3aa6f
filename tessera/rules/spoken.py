"""Spoken numbers as data: readings and ordered rewriting rules."""

from __future__ import annotations

from typing import NamedTuple


class Counter(NamedTuple):
    reading: str
    #: numbers that are read in a way of their own
    own: dict = {}
    #: endings of a number that are read together with the counter
    endings: tuple = ()
    #: sound of an h after a final n, where it is not b
    third: str = ""
    #: no sound changes
    plain: bool = False
    #: a leading zero is not spoken
    zero_padded: bool = False


# fixed values: readings of dates and hours, of nought before a point, of large units and of percent
MONTHS = "いちがつ にがつ さんがつ しがつ ごがつ ろくがつ しちがつ はちがつ くがつ じゅうがつ じゅういちがつ じゅうにがつ".split()
DAYS = {1: "ついたち", 2: "ふつか", 3: "みっか", 4: "よっか", 5: "いつか", 6: "むいか", 7: "なのか", 8: "ようか", 9: "ここのか", 10: "とおか", 14: "じゅうよっか", 19: "じゅうくにち", 20: "はつか", 24: "にじゅうよっか", 29: "にじゅうくにち"}
ONE_DAY = "いちにち"
HOUR_ENDINGS = (("よん", "よ"), ("なな", "しち"), ("きゅう", "く"))
NOUGHT = "れい"
LARGE = {"万": "まん", "億": "おく"}
LARGER = {"兆": "ちょう", "京": "けい"}
PERCENT = "ぱーせんと"

# fixed values: counters with their readings
COUNTERS = {
    "丁目": Counter("ちょうめ"), "科目": Counter("かもく"), "教科": Counter("きょうか"), "時間": Counter("じかん", zero_padded=True), "週間": Counter("しゅうかん"), "周年": Counter("しゅうねん"), "試合": Counter("しあい"),
    "種類": Counter("しゅるい"), "世紀": Counter("せいき"), "か月": Counter("かげつ"), "か所": Counter("かしょ"), "か国": Counter("かこく"), "歳": Counter("さい", {20: "はたち"}), "才": Counter("さい", {20: "はたち"}),
    "位": Counter("い"), "基": Counter("き"), "期": Counter("き"), "級": Counter("きゅう"), "台": Counter("だい"), "枚": Counter("まい"), "個": Counter("こ"), "本": Counter("ほん"), "冊": Counter("さつ"),
    "組": Counter("くみ", {1: "ひとくみ", 2: "ふたくみ"}, plain=True), "倍": Counter("ばい"), "匹": Counter("ひき"), "名": Counter("めい"), "人": Counter("にん", {1: "ひとり", 2: "ふたり"}, (("よん", "よにん"),)),
    "件": Counter("けん"), "校": Counter("こう"), "回": Counter("かい"), "階": Counter("かい", endings=(("さん", "さんがい"),)), "点": Counter("てん"),
    "泊": Counter("はく", endings=(("よん", "よんぱく"),), third="ぱ"), "杯": Counter("はい"), "週": Counter("しゅう"), "軒": Counter("けん", endings=(("さん", "さんげん"),)), "頭": Counter("とう"),
    "足": Counter("そく", endings=(("さん", "さんぞく"),)), "着": Counter("ちゃく"), "曲": Counter("きょく"), "社": Counter("しゃ"), "種": Counter("しゅ"), "室": Counter("しつ"), "席": Counter("せき"), "章": Counter("しょう"),
    "周": Counter("しゅう"), "缶": Counter("かん"), "巻": Counter("かん"), "歩": Counter("ほ", third="ぽ"), "発": Counter("はつ", third="ぱ"), "箱": Counter("箱", {1: "ひとはこ", 2: "ふたはこ"}), "通り": Counter("通り", {1: "ひととおり", 2: "ふたとおり"}),
    "分": Counter("ふん", endings=(("よん", "よんぷん"),), third="ぷ", zero_padded=True), "秒": Counter("びょう", zero_padded=True), "時": Counter("じ", zero_padded=True),
    "つ": Counter("つ", dict(enumerate("ひとつ ふたつ みっつ よっつ いつつ むっつ ななつ やっつ ここのつ".split(), 1))),
}
SAME_COUNTER = dict.fromkeys("かヶケカヵ箇", "か")
# fixed values: words that only begin like a counter
NOT_COUNTERS = {"本": "体部日当格来質学", "組": "織合", "階": "層段", "点": "検", "足": "しさすせそ", "着": "用", "曲": "線", "社": "会員長", "種": "目別", "室": "長", "周": "辺囲年", "歩": "道行", "発": "表見言売生展信達行明電音想", "分": "野析類担散布割岐解", "校": "門舎", "名": "古"}

# fixed values: units with their readings
UNITS = {
    "km²": "平方キロメートル", "km2": "平方キロメートル", "m²": "平方メートル", "m2": "平方メートル", "㎡": "平方メートル", "m³": "立方メートル", "m3": "立方メートル", "km": "キロメートル", "cm": "センチメートル", "mm": "ミリメートル",
    "kg": "キログラム", "mg": "ミリグラム", "mL": "ミリリットル", "ml": "ミリリットル", "kWh": "キロワット時", "kW": "キロワット", "dB": "デシベル", "m": "メートル", "g": "グラム", "L": "リットル", "W": "ワット", "V": "ボルト", "ha": "ヘクタール", "℃": "ど", "°C": "ど",
}
UNITS_ANY_CASE = {"eflops": "エクサフロップス", "pflops": "ペタフロップス", "tflops": "テラフロップス", "gflops": "ギガフロップス", "ghz": "ギガヘルツ", "mhz": "メガヘルツ", "khz": "キロヘルツ", "hz": "ヘルツ", "fps": "エフピーエス", "core": "コア", "cores": "コア"}
PREFIXES = {"k": "キロ", "m": "メガ", "g": "ギガ", "t": "テラ"}

# fixed values: patterns of what is written, in the order in which they are tried
_N, _EDGE, _DASH, _TILDE = r"\d[\d,]*", r"(?<![A-Za-z0-9])", "[-‐‑–—−]", "[~〜～]"
_WEEKDAY = "[月火水木金土日祝]"
_COUNTED = "|".join(w + (f"(?![{NOT_COUNTERS[w]}])" if w in NOT_COUNTERS else "") for w in sorted((c if c[0] != "か" else f"[{''.join(SAME_COUNTER)}]{c[1:]}" for c in COUNTERS), key=lambda w: (-len(w.split("]")[-1]) - ("]" in w), w)))
_UNITS = "|".join(sorted(UNITS, key=lambda u: -len(u)))
_ANY_CASE = "|".join(sorted(UNITS_ANY_CASE, key=lambda u: -len(u)))
#: What after hours and minutes tells that they are none: a unit.
_COUNT_AFTER = r"(?:[年人回件分%つ]|月(?![曜〜~～・])|日(?![本曜])|名(?!古)|校(?![門舎]))"
_MINUTES = rf"(\d{{2}})(?!\d)(?:(?<=[03]0)|(?!{_COUNT_AFTER}))"

#: Stages of (pattern, template), in order.
STAGES = (
    (
        (r"(?<!次)第(?=\s*\d)", "だい"),
        (r"(?<![A-Za-z0-9.])(\d{1,4}) (?=[年月](?![額曜]))", "{1}"),
        (r"(?<=[月/])(\d{1,2}) (?=日)", "{1}"),
        (r"(?:(?<=[年月])|(?<=\d/)) (?=\d)", ""),
        (r"(?<=\d),(?!\d{3}(?!\d))", "、"),
        (rf"[(（]({_WEEKDAY}(?:[・･、]?{_WEEKDAY}){{0,2}})[)）]", "、{weekdays:1}、"),
    ),
    ((r"(?<=[年月]) (?=\d)", ""), (r"(?<=[月/])(\d{1,2}) (?=日)", "{1}")),
    (
        (r"(?<![\d-])(\d{4})-(\d{1,2})-(\d{1,2})(?![\dT-])", "{date:1,2,3}"),
        (rf"〒\s*(\d{{3}})\s*{_DASH}\s*(\d{{4}})(?!\d)", "ゆうびんばんごう{numbers:1,2}"),
        (rf"(?<!\d)(0\d{{1,4}}){_DASH}(\d{{1,4}}){_DASH}(\d{{3,4}})(?!\d)", "{numbers:1,2,3}"),
        (rf"(町|丁目|番地)\s*(\d+)\s*{_DASH}\s*(\d+)(?:\s*{_DASH}\s*(\d+))?(?![\d.])", "{1}{blocks:2,3,4}"),
        (rf"(\d+)丁目\s*(\d+)\s*{_DASH}\s*(\d+)(?![\d.])", "{1}丁目{blocks:2,3}"),
        (rf"(?<=[一-鿿々ヶ])\s*(\d{{1,4}})\s*{_DASH}\s*(\d{{1,4}})\s*{_DASH}\s*(\d{{1,4}})(?![\d.]|\s*{_DASH}\s*\d)", "{blocks:1,2,3}"),
        (r"(?<![\d/.])(\d{4})/(\d{1,2})/(\d{1,2})(?:日(?![曜本]))?(?![\d/])", "{date:1,2,3}"),
        (r"(?<![A-Za-z\d/.])(?<!\d:)()(\d{1,2})/(\d{1,2})(?:日(?![曜本]))?(?![\d/])", "{date:1,2,3}"),
        (rf"[¥￥]\s*({_N})(?![\d.])", "{year:1}えん"),
        (rf"((?:質問|ポイント|ステップ|項目|手順|課題|パート|問題|問|例|その(?=\d:\d+(?:\s*{_TILDE}\s*\d+)?\s*{_COUNT_AFTER}))\s*)(\d{{1,2}})\s*:\s*(?=\d)", "{1}{2}、"),
        (rf"(?<!\d)(\d{{1,2}}):(\d{{2}})\s*(?:{_TILDE}|{_DASH})\s*(\d{{1,2}}):{_MINUTES}(?=\s*(?:まで|に))", "{clock:1,2}から{clock:3,4}"),
        (rf"(?<!\d)(\d{{1,2}}):(\d{{2}})\s*(?:{_TILDE}|{_DASH})\s*(\d{{1,2}}):{_MINUTES}", "{clock:1,2}から{clock:3,4}まで"),
        (rf"(?<!\d)(\d{{1,2}}):(\d{{2}})\s*{_TILDE}(?:\s*から)?(?!\d{{1,2}}\s*{_COUNT_AFTER}(?!\d))", "{clock:1,2}から"),
        (rf"(?<!\d)(\d{{1,2}}):(\d{{2}})\s*{_TILDE}(?=\d{{1,2}}月)", "{clock:1,2}から"),
        (rf"(?<!\d)(\d{{1,2}}):(\d{{2}}):(\d{{2}})(?!\d)", "{clock:1,2,3}"),
        (rf"(?<!\d)(\d{{1,2}}):{_MINUTES}", "{clock:1,2}"),
        (rf"{_EDGE}(\d{{1,2}})時(\d{{1,2}})分(?![{NOT_COUNTERS['分']}])", "{clock:1,2}"),
        (rf"(?<![A-Za-z0-9:.])(\d+):(\d)(?![\d:]|{_COUNT_AFTER})", "{whole:1}たい{whole:2}"),
    ),
    ((rf"(?<![A-Za-z0-9.,:/-])({_N})\s*[〜~～-]\s*({_N})(?=\s*({_COUNTED}|年|月|日|円|割|%|パーセント|万|億))", "{1}{3}から{2}"),),
    ((rf"(?<=\d)(\s*(?:{_COUNTED}|年度|年|月|日|円|割|%|パーセント|℃|度)(?:半|生)?(?:、(?:[月火水木金土日]曜日|祝日))*、?)\s*[-−]\s*(?=\d)", "{1}から"),),
    ((r"(?<![0-9A-Za-z+])(?<!\d\s)[-−－▲](?=\d)", "マイナス"), (r"\s*(?<![A-Za-z+])\+\s*(?=[A-Za-z])", "プラス"), (r"(?<=\d)\s*\+\s*(?=\d)", "プラス"), (r"(?<![A-Za-z+])\+(?=\d)", "プラス")),
    (
        (rf"{_EDGE}(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日", "{year:1}ねん{monthday:2,3}"),
        (rf"{_EDGE}(\d{{1,2}})月(\d{{1,2}})日", "{monthday:1,2}"),
        (rf"{_EDGE}(\d{{1,3}}(?:,\d{{3}})+|\d+)日間", "{days:1}かん"),
        (rf"{_EDGE}(\d{{1,3}}(?:,\d{{3}})+|\d+)日目", "{days:1}め"),
        (rf"{_EDGE}(\d{{4}})年度", "{year:1}ねんど"),
        (rf"{_EDGE}(\d+)年目", "{year:1}ねんめ"),
        (rf"{_EDGE}(\d+)年間", "{year:1}ねんかん"),
        (r"(?<=\d年)(\d{1,2})組", "{whole:1}くみ"),
        (r"(?<![A-Za-z0-9,.])(\d{1,4})年", "{year:1}ねん"),
        (rf"{_EDGE}(\d{{1,2}})月(?!曜)", "{month:1}"),
        (r"(?:(?<=月)|(?<=[今来先毎]月の))(\d+)日", "{day:1}"),
        (rf"{_EDGE}(\d+)日(?=、(?:[月火水木金土日]曜日|祝日))", "{day:1}"),
        (rf"{_EDGE}(\d{{1,3}}(?:,\d{{3}})+|\d+)日", "{days:1}"),
        (rf"{_EDGE}({_N})\s*円", "{year:1}えん"),
        (rf"{_EDGE}({_N}(?:\.\d+)?)([万億]?)\s*(?:(?=[KMGT][Bb]|[kmgt]b|kB))([KMGTkmgt])([Bb])(/s|ps)?(?![A-Za-z0-9])", "{data:1,2,3,4,5}"),
        (rf"{_EDGE}({_N}(?:\.\d+)?)([万億]?)\s*((?i:{_ANY_CASE}))(?![A-Za-z0-9])", "{unit:1,2,3}"),
        (rf"{_EDGE}({_N}(?:\.\d+)?)([万億]?)\s*({_UNITS})(?![A-Za-z0-9])(?!(?<=W)杯)", "{unit:1,2,3}"),
        (rf"{_EDGE}({_N}(?:\.\d+)?)\s*(?:%|パーセント)", "{percent:1}"),
        (r"(?<!\d)(?<!\d\.)(\d+(?:\.\d+){2,})(?![A-Za-z0-9])", "{point:1}"),
        (rf"(?<!\d)(?<!\d\.)({_N}\.\d+)(?![A-Za-z0-9]|\.\d)", "{point:1}"),
        (rf"{_EDGE}({_N})分の({_N})(?![\d.])", "{whole:1}ぶんの{whole:2}"),
        (rf"(?<![A-Za-z0-9.])({_N})(兆|京(?![都浜急阪葉王]))", "{larger:1,2}"),
        (rf"(?<![A-Za-z0-9.])({_N})(?=[万億])", "{large:1}"),
        (r"(?<=割)(\d)分", "{whole:1}ぶ"),
        (rf"{_EDGE}({_N})\s*(回)(?=答(?!え)|収(?![集録]))", "{whole:1}{2}"),
        (rf"{_EDGE}({_N})\s*({_COUNTED})", "{counter:1,2}"),
        (r"(?<![A-Za-z0-9,])(?<![A-Za-z0-9]\.)(\d{1,3})(?=[カキクケコサシスセソタチツテトパピプペポ])", "{ten:1}"),
        (rf"{_EDGE}(?<![A-Za-z0-9]\.)({_N})(?![A-Za-z0-9]|\.\d)", "{whole:1}"),
        (r"(?<=[A-Za-z+]\+)(\d+)(?![A-Za-z0-9])", "{whole:1}"),
    ),
    ((r"、(?:\s*、)+", "、"),),
    ((r"、\s*。", "。"), (r"、\s+", "、"), (r"\s+", " ")),
)
