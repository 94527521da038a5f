"""Column helpers for source text. All of them run inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Unicode word and blank classes, spelled out because Java's \w, \s and \b are ASCII.
WORD = r"\p{L}\p{N}_"
BLANK = r"\t-\r\x1c-\x20\x85\p{Z}"
#: The characters of ``BLANK`` one by one.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAK = r"\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x85\u2028\u2029]"
NEWLINE = r"\r\n|[\n\r]"


def portable(pattern: str) -> str:
    """Spell ``\\w``, ``\\s`` and ``\\b`` of an ``re`` pattern out for Java.

    ``\\b`` becomes the look-around for the side on which the pattern has a word
    character: before a letter or an opening bracket it guards a word start.
    """
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i:i + 2]
        if two == r"\w":
            out.append(WORD if inside else f"[{WORD}]")
        elif two == r"\s":
            out.append(BLANK if inside else f"[{BLANK}]")
        elif two == r"\b":
            follower = pattern[i + 2:i + 3]
            starts_word = follower.isalnum() or follower in ("(", "[")
            out.append(f"(?<![{WORD}])" if starts_word else f"(?![{WORD}])")
        elif two[0] == "\\":
            out.append(two)
        else:
            inside = two[0] == "[" or (inside and two[0] != "]")
            out.append(two[0])
            i += 1
            continue
        i += 2
    return "".join(out)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body uses it.

    Inside a lambda a plain column expression would be evaluated again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_array(df: DataFrame, keep: list, array: Column, value: str, position: str = "_at") -> DataFrame:
    """One row per array element, with its 0-based position.

    A plain ``explode`` makes the optimizer add "array is not empty" below it and so
    evaluates a computed array several times; the outer form does not.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(position, value)).where(F.col(position).isNotNull())


def strip(col: Column) -> Column:
    """Trim Unicode white space on both ends (``trim`` alone knows blanks only); the middle is not searched."""
    return F.trim(col, F.lit(BLANKS))


def is_blank(col: Column) -> Column:
    return ~col.rlike(rf"[^{BLANK}]")


def split_lines(col: Column, breaks: str = LINE_BREAK) -> Column:
    """Lines of a text with universal line ends; a final line end opens no new line."""
    return let(F.split(col, breaks, -1), closed)


def closed(pieces: Column) -> Column:
    """Lines from the pieces between line ends. ``pieces`` is used more than once: pass a column that is computed already."""
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, F.lit(1), F.size(pieces) - 1)).otherwise(pieces)


def contains_any(col: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(w)) for w in words])


def count_present(col: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in ``col`` at least once."""
    return reduce(lambda a, b: a + b, [F.contains(col, F.lit(w)).cast("int") for w in words])


def lookup(key: Column, table: dict, default) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Lower-cased suffix; its dot may be neither the first nor the last character."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+(\.[^.]+)\z", 1))


def html_escape(col: Column) -> Column:
    out = F.coalesce(col.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def human_size(size: Column, decimals: int = 2) -> Column:
    """``1536`` -> ``1.5 KB``; trailing zeros are dropped."""
    places = max(decimals, 0)
    units = ["Bytes", "KB", "MB", "GB", "TB"]
    out = F.lit(None).cast("string")
    for power, unit in reversed(list(enumerate(units))):
        number = F.format_string(f"%.{places}f", size.cast("double") / F.lit(float(1024 ** power)))
        if places:
            number = F.regexp_replace(number, r"\.?0+$", "")
        text = F.concat(number, F.lit(f" {unit}"))
        out = text if power == len(units) - 1 else F.when(size < 1024 ** (power + 1), text).otherwise(out)
    return F.when(size == 0, F.lit("0 Bytes")).otherwise(out)


def repository_name_from_url(url: Column) -> Column:
    """Last segment of an http(s) address without slash and ``.git``; NULL when unusable."""
    clean = F.regexp_replace(strip(url), r"/+\z", "")
    clean = F.regexp_replace(clean, r"\.git\z", "")
    name = F.substring_index(clean, "/", -1)
    return F.when(strip(url).rlike(r"^https?://") & (name != ""), name)


def safe_name(name: Column) -> Column:
    """Last path part of a repository name, NULL when it is empty, ``.`` or ``..``."""
    bare = F.regexp_replace(name, r"(/+\.?)+\z", "")
    last = F.substring_index(bare, "/", -1)
    return F.when(~is_blank(name) & ~last.isin("", ".", ".."), last)


def stays_inside(path: Column) -> Column:
    """True when a relative path never climbs above its root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    step = F.transform(parts, lambda p: F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1))
    lowest = F.aggregate(
        step,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low")),
        lambda acc, s: F.struct((acc["depth"] + s).alias("depth"), F.least(acc["low"], acc["depth"] + s).alias("low")),
        lambda acc: acc["low"],
    )
    return ~path.startswith("/") & (lowest >= 0)
