"""Catalogue copy: boilerplate, clean-up of bullets and subtitles, warranty claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import fixed
from shelfmark.functions.text import is_blank, quoted, replace_all, string_array, strip, with_value, words_pattern

BANNED = r"(?i)\b(?:" + words_pattern(fixed.BANNED_ADJECTIVES) + r")\b"
DANGLING = r"(?i)(?:(?:^|\s+)(?:" + words_pattern(fixed.DANGLING_WORDS) + r"))+$"
END_MARKS = ". ,;:-"


def boilerplate_phrase(text: Column) -> Column:
    """The first stock phrase the text contains, 'Empty text' for no text, null for a clean text."""
    found = with_value(F.lower(text), lambda low: F.get(F.filter(string_array(fixed.BOILERPLATE), lambda p: F.contains(low, p)), F.lit(0)))
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("Empty text")).otherwise(found)


def is_boilerplate(text: Column) -> Column:
    return boilerplate_phrase(text).isNotNull()


def claims_warranty(text: Column, strict_reference: bool = False) -> Column:
    """Does the text promise a warranty? The strict variant only knows the bare words."""
    pattern = r"(?i)\b(warrant|guarantee)\b" if strict_reference else r"(?i)\b(warrant\w*|guarantee\w*)"
    return F.coalesce(text.rlike(pattern), F.lit(False))


def normalise_copy(text: Column, brand: Column, max_chars: int = 60, min_chars: int = 20) -> Column:
    """struct(text, ok): brand and hype removed, cut at a word, no dangling word, closed with a full stop."""
    end = F.lit(END_MARKS)

    # a step that names its text more than once takes it ready-made
    def opened(t: Column) -> Column:
        capital = F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 2147483647))
        return F.rtrim(F.when(t.rlike(BANNED), F.lit("")).otherwise(capital), end)

    def cut(t: Column) -> Column:
        at_word = F.rtrim(replace_all(F.substring(t, 1, max_chars - 1), r" [^ ]*$"), end)
        return F.rtrim(replace_all(F.when(F.length(t) > max_chars - 1, at_word).otherwise(t), DANGLING), end)

    def closed(t: Column) -> Column:
        return F.when(t == "", F.lit("")).otherwise(F.concat(F.rtrim(t, F.lit(". ")), F.lit(".")))

    clean = strip(F.coalesce(text, F.lit("")))
    unbranded = replace_all(clean, F.concat(F.lit(r"(?i)\b"), quoted(brand), F.lit(r"\b")))
    clean = F.when(F.coalesce(brand, F.lit("")) == "", clean).otherwise(unbranded)
    clean = strip(replace_all(replace_all(clean, BANNED + r"\s*"), r"\s+", " "))
    clean = with_value(strip(replace_all(clean, r"^[-–—:,.\s]+")), opened)
    clean = with_value(with_value(clean, cut), closed)
    return with_value(clean, lambda t: F.struct(t.alias("text"), F.length(t).between(min_chars, max_chars).alias("ok")))


def normalise_copy_row(df: DataFrame, brand: str = "brand", strict_reference: bool = False) -> DataFrame:
    """Clean drafted copy: title, subtitle and bullets 1-4 of each row, plus copy_ok.

    The first two bullets are required, the last two become null when they do not hold up.
    """
    owner = F.col(brand)
    title = replace_all(strip(F.coalesce(F.col("title"), F.lit(""))), r"\s+", " ")
    title = F.when(
        F.length(title) > 40, F.rtrim(replace_all(F.substring(title, 1, 40), r" [^ ]*$"), F.lit(" ,;:-"))
    ).otherwise(title)
    subtitle = normalise_copy(F.col("subtitle"), owner, 80, 15)
    out = df.withColumn("title", title).withColumn("_subtitle", subtitle)
    for n in range(1, 5):
        out = out.withColumn(f"_bullet_{n}", normalise_copy(F.col(f"bullet_{n}"), owner, 60, 15))
    bad = {n: claims_warranty(F.col(f"_bullet_{n}.text"), strict_reference) for n in range(1, 5)}
    kept, fine = {}, [F.col("_subtitle.text") != ""]
    for n in (1, 2):
        kept[f"bullet_{n}"] = F.when(bad[n], F.lit("")).otherwise(F.col(f"_bullet_{n}.text"))
        fine.append(F.col(f"_bullet_{n}.ok") & ~bad[n])
    for n in (3, 4):
        given = ~is_blank(F.col(f"bullet_{n}")) & ~F.lower(strip(F.col(f"bullet_{n}"))).isin("none", "null")
        usable = given & (F.col(f"_bullet_{n}.text") != "") & F.col(f"_bullet_{n}.ok") & ~bad[n]
        kept[f"bullet_{n}"] = F.when(usable, F.col(f"_bullet_{n}.text"))
    all_fine = fine[0] & fine[1] & fine[2]
    out = out.withColumns({**kept, "subtitle": F.col("_subtitle.text"), "copy_ok": all_fine})
    return out.drop("_subtitle", *[f"_bullet_{n}" for n in range(1, 5)])
