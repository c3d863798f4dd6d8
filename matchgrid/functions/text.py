"""Column functions over names, labels, decisions and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed vocabularies.
YES = ("yes", "y", "same", "merge", "1", "true", "ok")
NO = ("no", "n", "different", "0", "false")


def rate(text: Column) -> Column:
    """A frame rate like ``24000/1001`` or ``25``; a zero denominator is 0."""
    top = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    bottom = F.coalesce(F.split_part(text, F.lit("/"), F.lit(2)).try_cast("double"), F.lit(1.0))
    return F.when(top.isNull(), F.lit(None).cast("double")).when(bottom == 0, 0.0).otherwise(top / F.when(bottom != 0, bottom))


def frame_name(number: Column) -> Column:
    return F.format_string("frame_%06d.jpg", number)


def frame_number(name: Column) -> Column:
    """The second part of a file name if it is all digits, else 0."""
    part = F.split_part(name, F.lit("_"), F.lit(2))
    return F.when(part.rlike("^[0-9]+$"), part.try_cast("long")).otherwise(F.lit(0).cast("long"))


def data_url(content: Column) -> Column:
    # Spark breaks long base64 text into lines.
    return F.concat(F.lit("data:image/jpeg;base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit("")))


def group_of_hint(hint: Column) -> Column:
    """1 green, 2 black, 3 anything else."""
    h = F.upper(F.trim(hint))
    return F.when(h.isin("GREEN", "緑", "A"), 1).when(h.isin("BLACK", "黒", "B"), 2).otherwise(3)


def team_of_group(group: Column) -> Column:
    return F.when(group == 1, "A").when(group == 2, "B").otherwise("?")


def swapped(team: Column) -> Column:
    return F.when(team == "A", "B").when(team == "B", "A").otherwise(team)


def members(text: Column) -> Column:
    """The integers of a list separated by spaces or commas; other words are skipped."""
    return F.filter(F.transform(F.split(F.translate(text, ",", " "), " "), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def decision(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(*YES), "yes").when(t.isin(*NO), "no").otherwise("uncertain")


def html_escape(text: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def halo(r: Column, g: Column, b: Column) -> Column:
    """The outline colour that stands out from a fill."""
    return F.when(0.299 * r + 0.587 * g + 0.114 * b > 140, "black").otherwise("white")


def yolo_label(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> Column:
    """Class 0, then centre and size of the box within the image, relative."""
    a, b = F.least(F.greatest(x1, F.lit(0.0)), F.lit(width)), F.least(F.greatest(x2, F.lit(0.0)), F.lit(width))
    c, e = F.least(F.greatest(y1, F.lit(0.0)), F.lit(height)), F.least(F.greatest(y2, F.lit(0.0)), F.lit(height))
    left, right, top, bottom = F.least(a, b), F.greatest(a, b), F.least(c, e), F.greatest(c, e)
    parts = ((left + right) / 2 / width, (top + bottom) / 2 / height, (right - left) / width, (bottom - top) / height)
    return F.format_string("0 %.6f %.6f %.6f %.6f", *parts)
