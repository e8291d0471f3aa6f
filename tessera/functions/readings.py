"""Japanese readings of whole numbers, as Column expressions over rule tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: readings of digits, of the places of a group of four digits, and of the groups
ONES = ["", "いち", "に", "さん", "よん", "ご", "ろく", "なな", "はち", "きゅう"]
TENS = ["", "じゅう", "にじゅう", "さんじゅう", "よんじゅう", "ごじゅう", "ろくじゅう", "ななじゅう", "はちじゅう", "きゅうじゅう"]
HUNDREDS = ["", "ひゃく", "にひゃく", "さんびゃく", "よんひゃく", "ごひゃく", "ろっぴゃく", "ななひゃく", "はっぴゃく", "きゅうひゃく"]
THOUSANDS = ["", "せん", "にせん", "さんぜん", "よんせん", "ごせん", "ろくせん", "ななせん", "はっせん", "きゅうせん"]
GROUPS = ["", "まん", "おく", "ちょう", "けい"]
DIGITS = ["ぜろ", "いち", "に", "さん", "よん", "ご", "ろく", "なな", "はち", "きゅう"]
# fixed values: endings that are shortened before the two largest groups, and before the largest alone
SHORTENED = (("いち", "いっ"), ("はち", "はっ"), ("じゅう", "じゅっ"))
SHORTENED_HUNDREDS = (("ひゃく", "ひゃっ"), ("びゃく", "びゃっ"), ("ぴゃく", "ぴゃっ"))


def group_reading(n: Column) -> Column:
    """Reading of 0 (empty) to 9999."""
    digit = lambda place: (F.call_function("div", n, F.lit(10**place)) % 10).cast("int")
    pick = lambda names, place: F.element_at(F.array(*map(F.lit, names)), digit(place) + 1)
    return F.concat(pick(THOUSANDS, 3), pick(HUNDREDS, 2), pick(TENS, 1), pick(ONES, 0))


def digits_reading(c: Column) -> Column:
    """Each digit by its name."""
    names = F.array(*map(F.lit, DIGITS))
    return F.array_join(F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.element_at(names, x.cast("int") + 1)), "")


def number_reading(c: Column) -> Column:
    """Reading of the digits of a string, commas passed over: up to 20 digits as a number, else (or with a leading zero) one by one.

    A thousand before a large unit is "one thousand"; before the two largest
    units a final one, eight or ten is shortened, before the largest a hundred
    too.  What is no run of digits stays as it is.
    """
    digits = F.replace(c, F.lit(","), F.lit(""))
    padded = F.lpad(digits, 4 * len(GROUPS), "0")
    parts = []
    for i in range(len(GROUPS) - 1, -1, -1):
        group = F.substring(padded, 4 * (len(GROUPS) - 1 - i) + 1, 4).try_cast("int")
        read = group_reading(group)
        if i > 0:
            read = F.regexp_replace(read, "^せん", "いっせん")
        if i >= 3:
            for ending, short in SHORTENED + (SHORTENED_HUNDREDS if i == 4 else ()):
                read = F.regexp_replace(read, f"{ending}$", short)
        parts.append(F.when(group == 0, "").otherwise(F.concat(read, F.lit(GROUPS[i]))))
    one_by_one = (F.length(digits) > 4 * len(GROUPS)) | ((F.length(digits) > 1) & digits.startswith("0"))
    whole = F.when(one_by_one, digits_reading(digits)).when(digits == "0", DIGITS[0]).otherwise(F.concat(*parts))
    return F.when(digits.rlike("^[0-9]+$"), whole).otherwise(c)


def integer_reading(n: Column) -> Column:
    """Reading of a whole number from 0 on."""
    return number_reading(n.cast("string"))
