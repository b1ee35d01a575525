"""Caption policy as Column builders: clean-up, validation codes, triggers, tokens.

A rule set returns the code of the first rule that a caption breaks, or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import casefold, first_match, let, literal_pattern, strip

# The tags, markers and word lists of the caption policy.
REASONING_TAGS = ("think", "thinking", "reasoning", "reflection", "thought")
REASONING_BLOCK = r"(?is)<{tag}[^>]*>.*?</{tag}>"
REASONING_OPENING = r"(?is)\A\s*(thinking|reasoning|reflection|thought process):.*?\n\s*\n"
ANSWER_MARKER = r"(?ims)\A.*^\s*[*_#> ]*(?:final caption|final answer|caption)\s*[:*_]*\s*$\n?(.*)\z"
QUOTES = (('"', '"'), ("“", "”"), ("'", "'"), ("‘", "’"))
LIST_LINE = r"^(?:[-*•]|\d+[.)])\s+"
META_OPENING = r"(?i)^(?:here(?:'s| is)|i (?:see|can see)|the image (?:shows|depicts)|analysis:|caption:)"
NEGATIVE_PROMPT = r"(?i)(?:^|[,.;]\s*)negative prompt\s*:"
QUOTED = r'"(?:\\.|[^"\\])*"|“[^”]*”'
ABSENCE = (
    r"\b(?:no|not|never|without|none|nothing|nobody)\b",
    r"\b(?:isn't|aren't|wasn't|weren't|doesn't|don't|didn't|can't|cannot)\b",
    r"\b(?:free|clear)\s+of\b",
    r"\b(?:absent|removed|eliminated|missing|lacks?|lacking)\b",
)
META_LANGUAGE = (
    r"\bincidental details?\b",
    r"\b(?:training|dataset|caption|prompt)\b",
    r"\b(?:analysis|reasoning|instructions?|explanations?|notes?)\b",
    r"\bidentity\b",
    r"\b(?:remain|stays?|kept)\s+(?:separate|distinct|controllable)\b",
    r"\b(?:separate|distinct)\s+from\b",
    r"\bnot\s+part\s+of\b",
)
VIDEO_PROHIBITED = (r"appears? to", r"seems? to", "probably", "possibly", "masterpiece", "best quality", "4k", "highly detailed", "professional")
METADATA_TAG = (
    r"(?i)^(?:masterpiece|best quality|good quality|normal quality|low quality|worst quality|score_[1-9]|year \d{4}|newest|recent|mid|early|old|"
    r"highres|absurdres|anime screenshot|jpeg artifacts|official art|safe|sensitive|nsfw|explicit)$"
)
SUBJECT_COUNT_TAG = r"(?i)^\d+(?:girls?|boys?|others?)$"
DESCRIPTOR_STOPWORDS = (
    "a", "an", "and", "as", "at", "by", "for", "from", "in", "into", "of", "on", "or", "the", "to", "under", "with", "while", "he", "she", "they", "his",
    "her", "their", "this", "that",
)


def strip_reasoning(text: Column) -> Column:
    """Drops reasoning blocks, an opening thinking paragraph, all up to the last caption marker, back-ticks and one pair of quotes."""
    v = F.coalesce(text, F.lit(""))
    blocks = v
    for tag in REASONING_TAGS:
        blocks = F.regexp_replace(blocks, REASONING_BLOCK.format(tag=tag), "")
    v = let(v, lambda x: F.when(F.contains(x, F.lit("</")), blocks).otherwise(x))  # most texts have no tag at all
    v = let(v, lambda x: F.when(F.contains(x, F.lit(":")), F.regexp_replace(x, REASONING_OPENING, "")).otherwise(x))
    after = lambda x: F.when(F.contains(F.lower(x), F.lit("caption")) | F.contains(F.lower(x), F.lit("final answer")), strip(F.regexp_extract(x, ANSWER_MARKER, 1))).otherwise("")
    answer = let(v, lambda x: let(after(x), lambda a: strip(strip(strip(F.when(a != "", a).otherwise(x)), "`"))))
    unquoted = lambda x: F.coalesce(*(F.when((F.length(x) >= 2) & x.startswith(a) & x.endswith(b), strip(F.substring(x, F.lit(2), F.length(x) - 2))) for a, b in QUOTES), x)
    return let(answer, unquoted)


def caption_lines(stripped: Column) -> Column:
    lines = F.transform(F.split(stripped, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"), lambda x: strip(x))
    return F.filter(lines, lambda x: x != "")


def joined_caption(lines: Column) -> Column:
    return strip(F.regexp_replace(F.array_join(lines, " "), r"(?U)\s+", " "))


def normalize_error(lines: Column, caption: Column, max_characters: int = 4000) -> Column:
    return first_match([
        (F.exists(lines, lambda x: x.rlike(LIST_LINE)), "list"),
        (caption == "", "empty"),
        (F.length(caption) > max_characters, "too_long"),
        (caption.rlike(META_OPENING), "meta_commentary"),
        (caption.rlike(NEGATIVE_PROMPT), "negative_prompt"),
    ])


def positive_only_error(caption: Column) -> Column:
    prose = F.regexp_replace(caption, QUOTED, " ")
    pattern = "(?iU)" + "|".join(f"(?:{p})" for p in ABSENCE)
    return F.when(prose.rlike(pattern), F.lit("absence_language"))


def caption_words(caption: Column) -> Column:
    """Words that begin and end with a letter, digit or underscore and may hold $, apostrophes and hyphens."""
    return F.size(F.regexp_extract_all(caption, F.lit(r"(?U)(\b[\w$'-]+\b)"), F.lit(1)))


def direct_language_error(caption: Column, max_words: int = 120) -> Column:
    pattern = "(?iU)" + "|".join(f"(?:{p})" for p in META_LANGUAGE)
    return first_match([(caption.rlike(pattern), "meta_language"), (caption_words(caption) > max_words, "too_many_words")])


def without_trigger(caption: Column, trigger: str) -> Column:
    """Without the first occurrence, in any case, of the trigger, stripped of blanks and commas."""
    if not trigger:
        return caption
    first = literal_pattern(trigger).removeprefix("(?iu)")
    return F.regexp_replace(F.regexp_replace(caption, rf"(?isu)\A(.*?){first}", "$1"), r"\A[ ,]+|[ ,]+\z", "")


def tags_of(caption: Column) -> Column:
    return F.filter(F.transform(F.split(caption, ","), lambda x: strip(x)), lambda x: x != "")


def tag_error(tags: Column, trigger: str = "", positive_only: bool = True) -> Column:
    is_trigger = (lambda t: casefold(t) == casefold(F.lit(trigger))) if trigger else (lambda t: F.lit(False))
    absent = F.exists(tags, lambda t: ~is_trigger(t) & positive_only_error(F.replace(t, F.lit("_"), F.lit(" "))).isNotNull())
    rules = [
        (F.size(tags) < 2, "not_tags"),
        (F.exists(tags, lambda t: F.length(t) > 100), "prose_length_tag"),
        (F.exists(tags, lambda t: t.startswith("@")), "artist_tag"),
    ]
    return first_match(rules + ([(absent, "absence_language")] if positive_only else []))


def profile_error(caption: Column, profile: dict) -> Column:
    """The code for a normalised caption under a profile's settings."""
    s, trigger = profile["settings"], profile.get("trigger", "").strip()
    if s.get("caption_output_format") == "comma_separated_tags":
        return tag_error(tags_of(caption), trigger, s.get("positive_caption_only", True))
    bare = without_trigger(caption, trigger)
    direct = direct_language_error(bare, s.get("caption_max_words", 120))
    return F.coalesce(positive_only_error(bare), direct) if s.get("positive_caption_only", True) else direct


def video_error(caption: Column) -> Column:
    """The first prohibited expression of video captions."""
    return first_match([(caption.rlike(rf"(?iU)\b{p}\b"), p.replace("?", "").replace(" ", "_")) for p in VIDEO_PROHIBITED])


def apply_video_trigger(caption: Column, trigger: str) -> Column:
    if not trigger:
        return caption
    bare = without_trigger(caption, trigger)
    return F.when(bare != "", F.concat(F.lit(f"{trigger}, "), bare)).otherwise(F.lit(trigger))


def apply_trigger(caption: Column, trigger: str, behavior: str = "prefix") -> Column:
    if not trigger:
        return caption
    if behavior == "anima_subject_slot":
        tags = tags_of(caption)
        # the slot follows the leading metadata tags and the subject counts right behind them
        lead = lambda pattern, start: F.aggregate(
            tags, F.struct(F.lit(0).alias("i"), start.alias("n")),
            lambda a, t: F.struct((a["i"] + 1).alias("i"), F.when((a["i"] == a["n"]) & t.rlike(pattern), a["n"] + 1).otherwise(a["n"]).alias("n")))["n"]
        slot = lead(SUBJECT_COUNT_TAG, lead(METADATA_TAG, F.lit(0)))
        have = F.exists(tags, lambda t: casefold(t) == casefold(F.lit(trigger)))
        put = F.concat(F.slice(tags, F.lit(1), slot), F.array(F.lit(trigger)), F.slice(tags, slot + 1, F.size(tags)))
        return F.array_join(F.when(have, tags).otherwise(put), ", ")
    gap = ", " if behavior in ("prefix", "contextual", "contextual_prefix") else " "
    return F.when(F.contains(casefold(caption), casefold(F.lit(trigger))), caption).otherwise(strip(F.concat(F.lit(trigger + gap), caption)))


def whitespace_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\s]+")).cast("long")


def descriptor_tokens(caption: Column, trigger: str = "") -> Column:
    text = F.regexp_replace(caption, literal_pattern(trigger), " ") if trigger else caption
    tokens = F.transform(F.regexp_extract_all(text, F.lit(r"(?U)([\w$'-]+)"), F.lit(1)), lambda t: F.regexp_replace(casefold(t), r"\A['-]+|['-]+\z", ""))
    return F.filter(tokens, lambda t: t != "")


def message_text(content: Column, parts: Column, reasoning_content: Column, reasoning: Column) -> Column:
    """A reply's text: its string or its joined text parts, else its reasoning fields; the first that is not empty, stripped."""
    full = lambda c: F.when(c != "", c)
    return strip(F.coalesce(full(content), full(F.array_join(parts, "")), full(reasoning_content), full(reasoning), F.lit("")))
