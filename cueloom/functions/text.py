"""Text functions of captions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cueloom.functions.words import BREAK_AFTER, CLOSERS, DANGLING_WORDS, FILLERS, HESITATIONS, REPLY_FILLERS, SENTENCE_MARKS, SHORTENINGS

_SPACE = r"(?U)\s+"
_CUT = "\u0001"


def squeeze(c: Column) -> Column:
    """White space runs become one space, and none is left at the ends."""
    return F.btrim(F.regexp_replace(c, _SPACE, " "))


def strip(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def is_blank(c: Column) -> Column:
    return F.coalesce(~c.rlike(r"(?U)\S"), F.lit(True))


def clean_caption_text(c: Column) -> Column:
    """Without inline times, colour and other tags; four entities decoded; white space squeezed."""
    for pattern in (r"<\d{2}:\d{2}:\d{2}[.,]\d{3}>", "</?c>", "<[^>]+>"):
        c = F.regexp_replace(c, pattern, "")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def normalize_cue_text(c: Column) -> Column:
    """Squeezed, without hesitations, with tidy commas and none at the ends."""
    c = strip(F.regexp_replace(c, _SPACE, " "), " ,")
    c = F.regexp_replace(c, rf"(?iU)\b(?:{HESITATIONS})\b", "")
    c = F.regexp_replace(F.regexp_replace(c, r"(?U)\s+,", ","), r"(?U),\s*,+", ",")
    return strip(F.regexp_replace(c, _SPACE, " "), " ,")


def drop_fillers(c: Column) -> Column:
    c = F.regexp_replace(c, rf"(?iU)\b(?:{FILLERS})\b", " ")
    return strip(F.regexp_replace(c, _SPACE, " "), " ,")


def ends_sentence(c: Column) -> Column:
    return c.rlike(rf"(?U)[{SENTENCE_MARKS}][{CLOSERS}]*\s*\z")


def dangling_end(c: Column) -> Column:
    """The last word is one after which more must follow, and no sentence ends there."""
    pattern = rf"(?iU)\b(?:{DANGLING_WORDS})\s*\z"
    return ~is_blank(c) & ~ends_sentence(c) & (F.rtrim(squeeze(c), F.lit(" ,;:-")).rlike(pattern) | c.rlike(pattern))


def starts_continuation(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*[\p{Ll}\p{Nd}]")


def word_count(c: Column) -> Column:
    return F.when(is_blank(c), 0).otherwise(F.size(F.split(squeeze(c), " ")))


def mid_sentence_cut(before: Column, after: Column) -> Column:
    """Whether a cut between two texts would clearly orphan a fragment."""
    n = word_count(after)
    return (
        F.when(is_blank(before) | is_blank(after), ~is_blank(after))
        .when(ends_sentence(before), False)
        .when(dangling_end(before), True)
        .otherwise(((n <= 3) & ends_sentence(after)) | ((n <= 2) & starts_continuation(after)))
    )


def join_text(a: Column, b: Column) -> Column:
    return squeeze(F.concat_ws(" ", a, b))


def is_untranslated(zh: Column, en: Column) -> Column:
    """The translation is only the source text without fillers."""
    plain = drop_fillers(en)
    return F.coalesce(~is_blank(zh) & (plain != "") & (F.lower(squeeze_ends(zh)) == F.lower(plain)), F.lit(False))


def squeeze_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def escape_ass(c: Column) -> Column:
    return F.translate(c, "\n{}", " ()")


def split_sentences(c: Column) -> Column:
    """Array of sentences of a normalised text; empty for a blank one."""
    marked = F.regexp_replace(normalize_cue_text(c), rf"(?U)([{SENTENCE_MARKS}][{CLOSERS}]*)(?:\s+|\z)", "$1" + _CUT)
    return F.filter(F.transform(F.split(marked, _CUT), lambda p: F.trim(p)), lambda p: p != "")


def wrap_caption(c: Column, width: int = 32) -> Column:
    r"""Lines of at most width characters joined by ``\N``, broken after punctuation in the second half where possible."""
    c = squeeze(c)
    half = max(width // 2, 1)
    pattern = rf"(.{{1,{width}}}$|.{{{half - 1},{width - 1}}}[{BREAK_AFTER}]|.{{{width}}})\s*"
    lines = F.filter(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.length(c) <= width, c).otherwise(F.array_join(lines, "\\N"))


def clean_reply(c: Column) -> Column:
    """One translated line: full-width commas, single spaces, no commas at the ends, no spoken fillers."""
    c = strip(F.regexp_replace(F.replace(c, F.lit(","), F.lit("，")), " {2,}", " "), "，, ")
    for filler in REPLY_FILLERS:
        c = F.replace(c, F.lit(filler), F.lit(""))
    return c


def strip_fence(c: Column) -> Column:
    """A reply without the code fence around it."""
    return squeeze_ends(F.regexp_replace(F.regexp_replace(c, r"^```(?:text|markdown)?\s*", ""), r"\s*```\z", ""))


def parse_numbered(c: Column, expected: Column) -> Column:
    """Array of (n, pos, text) for lines like ``3. text`` with 1 <= n <= expected; quotes around the text go."""
    lines = F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n")
    pattern = r"^\s*(\d+)\.\s*(.*?)\s*$"
    rows = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("pos")))
    rows = F.filter(rows, lambda r: r["line"].rlike(r"^\s*\d+\.\s*\S"))
    quotes = "^[\"'“”]+|[\"'“”]+$"
    parsed = F.transform(rows, lambda r: F.struct(F.regexp_extract(r["line"], pattern, 1).cast("long").alias("n"), r["pos"].alias("pos"), F.trim(F.regexp_replace(F.regexp_extract(r["line"], pattern, 2), quotes, "")).alias("text")))
    return F.filter(parsed, lambda p: (p["n"] >= 1) & (p["n"] <= expected) & (p["text"] != ""))


def shorten_candidates(c: Column) -> Column:
    """Distinct shortenings in order: the text, after each deletion that changes it, and fully compacted."""
    steps = F.array(*[F.struct(F.lit(old).alias("old"), F.lit(new).alias("new")) for old, new in SHORTENINGS])

    def shorten(state: Column, step: Column) -> Column:
        changed = F.replace(state["t"], step["old"], step["new"])
        tidy = strip(F.regexp_replace(changed, r"[，。\s]{2,}", "，"), "，。 ")
        t = F.when(changed != state["t"], tidy).otherwise(state["t"])
        return F.struct(t.alias("t"), F.concat(state["out"], F.array(t)).alias("out"))

    found = F.aggregate(steps, F.struct(c.alias("t"), F.array(c).alias("out")), shorten)["out"]
    compact = strip(F.regexp_replace(c, r"[，。！？、\s]+", "，"), "，")
    return F.filter(F.array_distinct(F.concat(found, F.array(compact))), lambda x: x != "")


def line_hash(x: Column) -> Column:
    """A hash that tells whether a stored line belongs to the same sentence; null counts as empty."""
    return F.xxhash64(F.coalesce(x, F.lit("")))
