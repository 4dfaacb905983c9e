"""Token and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that do not count as overlap.
STOPWORDS = ("the", "a", "an", "of", "and", "or", "to", "in", "on", "for", "with", "at", "is", "it", "this", "that", "by", "as", "be", "are", "from")
#: Labels that stand for a sound.
SOUNDS = {
    "cheer": ("cheer", "crowd", "applause", "clap", "chant", "ovation"),
    "crowd": ("crowd", "cheer", "applause", "chatter", "hubbub"),
    "applause": ("applause", "clap", "cheer", "ovation"),
    "clap": ("clap", "applause", "cheer"),
    "laugh": ("laugh", "giggle", "chuckle"),
    "music": ("music", "musical instrument", "song", "singing", "melody"),
    "song": ("song", "singing", "music"),
    "sing": ("singing", "song", "music", "vocal"),
    "talk": ("speech", "conversation", "narration", "monologue", "talk"),
    "speak": ("speech", "conversation", "narration", "monologue"),
    "speech": ("speech", "conversation", "narration", "monologue"),
    "shout": ("shout", "yell", "screaming", "cheer"),
    "scream": ("screaming", "shout", "yell"),
    "whistle": ("whistle",),
    "dog": ("dog", "bark", "animal"),
    "car": ("vehicle", "car", "engine", "motor"),
    "engine": ("engine", "motor", "vehicle"),
    "water": ("water", "liquid", "splash", "stream"),
    "footstep": ("footstep", "walk", "steps"),
}


def tokens(text: Column, least: int = 2, without: tuple[str, ...] = ()) -> Column:
    """Distinct runs of a-z and 0-9 of the lower-cased text, of ``least`` characters or more."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))
    found = F.filter(found, lambda t: F.length(t) >= least)
    return F.array_except(found, F.array(*map(F.lit, without))) if without else found


def any_term(label: Column, terms: list[str]) -> Column:
    """Whether the lower-cased label contains any of the terms."""
    rule = F.lit(False)
    for t in terms:
        rule |= F.lower(label).contains(t)
    return rule


def expanded(query: str, synonyms: dict[str, tuple[str, ...]] = SOUNDS) -> list[str]:
    """The query and every synonym set whose key or one of whose members occurs in it; nothing for a blank query."""
    q = query.strip().lower()
    sets = [members for key, members in synonyms.items() if key in q or any(m in q for m in members)] if q else []
    return sorted({q, *(m for members in sets for m in members)} - {""})


def canonical(name: Column) -> Column:
    """Lower case, anything but letters, digits, underscores and white space as a space, white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def clock(seconds: Column) -> Column:
    """MM:SS, seconds rounded half to even."""
    s = F.bround(seconds, 0).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def strip(text: Column) -> Column:
    """Without white space at the ends; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")


def relation_name(description: Column, longest: int = 120) -> Column:
    """The description's first sentence, cut, lower-cased; "related_to" if nothing is left."""
    return F.coalesce(F.nullif(strip(F.lower(F.substring(F.substring_index(description, ".", 1), 1, longest))), F.lit("")), F.lit("related_to"))


_CITATION = r"\[(\d{1,2}):(\d{2})\s*[-–]\s*(\d{1,2}):(\d{2})\]"


def citations(answer: Column) -> Column:
    """Spans ``[mm:ss-mm:ss]`` (a hyphen or an en dash) of a text, in order, as structs of t_start and t_end in seconds."""
    parts = [F.regexp_extract_all(answer, F.lit(_CITATION), F.lit(i)) for i in range(1, 5)]
    seconds = lambda z, m, s: (z[m].cast("int") * 60 + z[s].cast("int")).cast("double")
    return F.transform(F.arrays_zip(*(p.alias(n) for p, n in zip(parts, "abcd", strict=True))), lambda z: F.struct(seconds(z, "a", "b").alias("t_start"), seconds(z, "c", "d").alias("t_end")))


#: What comes before and after the object in a question for a time.
_ASKED = r"^(?:show me\s+|find\s+)?(?:when|at what time|what time|where)\s*(?:is|are|was|were|does|do|did|will)?\s*"
_HAPPENS = ("happen", "happens", "happened", "occur", "occurs", "occurred", "appear", "appears", "appeared", "added", "shown", "seen", "visible", "used", "is", "are", "was", "were")


def object_phrase(query: Column) -> Column:
    """The object of a "when does X happen" question, with a full stop; empty if none is left."""
    q = F.regexp_replace(strip(query), r"^[?.!]+|[?.!]+$", "")
    q = F.regexp_replace(F.lower(q), _ASKED, "")
    q = F.trim(F.regexp_replace(q, r"\s+", " "))
    q = F.regexp_replace(q, rf"(?:(?:^|\s)(?:{'|'.join(_HAPPENS)}))+$", "")
    q = F.trim(F.regexp_replace(q, r"^(?:(?:the|a|an)(?:\s|$))+", ""))
    return F.when(q != "", F.concat(q, F.lit("."))).otherwise("")


def named_parts(text: Column) -> Column:
    """A struct of the description and the tokens of its line ``NAMES: a, b``; without such a line, or with "none", no tokens."""
    pattern, t = r"(?im)^\s*names\s*:\s*(.*)$", strip(text)
    raw = F.trim(F.regexp_extract(t, pattern, 1))
    tokens = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: (x != "") & (F.lower(x) != "none"))
    found = t.rlike(pattern)
    rest = strip(F.concat(F.regexp_replace(t, r"(?is)(?m)^\s*names\s*:.*\z", ""), F.regexp_extract(t, r"(?ims)^\s*names\s*:[^\n]*$(.*)\z", 1)))
    return F.struct(F.when(found, rest).otherwise(t).alias("description"), F.when(found & (raw != ""), tokens).otherwise(F.array().cast("array<string>")).alias("tokens"))


def stitched(caption: Column, transcript: Column, shown: Column, sounds: Column) -> Column:
    """A segment's summary: caption, what is said, what is shown and its first three sounds (an array of labels)."""
    part = lambda c, before: F.when(strip(c) != "", F.concat(F.lit(before), strip(c)))
    top = F.array_join(F.filter(F.slice(F.coalesce(sounds, F.array().cast("array<string>")), 1, 3), lambda x: x != ""), ", ")
    text = F.concat_ws(" | ", part(caption, ""), part(transcript, "Said: "), part(shown, "On-screen: "), F.when(top != "", F.concat(F.lit("Audio: "), top)))
    return F.when(text != "", text).otherwise("(silent / no detected content)")


def embedding_text(*parts: Column) -> Column:
    """The parts that are not empty, joined; a space if there are none."""
    text = F.concat_ws(" | ", *(F.nullif(p, F.lit("")) for p in parts))
    return F.when(text != "", text).otherwise(" ")


def timeline_line(t_start: Column, t_end: Column, signals: dict[str, Column], sounds: Column, first: str = "auto", longest: int = 400) -> Column:
    """A line of a shot's signals (cap, asr, ocr), the order led by ``first`` (ocr, asr or caption), and its sounds."""
    order = {"ocr": ("ocr", "cap", "asr"), "asr": ("asr", "cap", "ocr")}.get(first, ("cap", "asr", "ocr"))
    bits = [F.when(strip(signals[k]) != "", F.concat(F.lit(f"{k}="), strip(signals[k]))) for k in order]
    top = F.array_join(F.filter(F.slice(F.coalesce(sounds, F.array().cast("array<string>")), 1, 3), lambda x: x != ""), ", ")
    text = F.concat_ws(" | ", *bits, F.when(top != "", F.concat(F.lit("audio=["), top, F.lit("]"))))
    text = F.when(text != "", text).otherwise("(silent, no caption)")
    return F.substring(F.concat(F.format_string("[%.1f-%.1fs] ", t_start, t_end), text), 1, longest)


def coerced(value: Column, kind: str, allowed: tuple[str, ...] = (), any_case: bool = False) -> Column:
    """A field's text as its type (number, boolean or string), null where it does not fit or is not ``allowed``."""
    if kind == "number":
        return value.try_cast("double")
    if kind == "boolean":
        return F.lower(value).isin("true", "yes", "1")
    if not allowed:
        return value
    if any_case:
        hit = F.array_position(F.array(*(F.lit(a.lower()) for a in allowed)), F.lower(value))
        return F.when(hit > 0, F.element_at(F.array(*map(F.lit, allowed)), F.greatest(hit, F.lit(1)).cast("int")))
    return F.when(value.isin(*allowed), value)


def approximate_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def first_that_fits(budget: int, *texts: Column) -> Column:
    """The first text within a budget of approximate tokens; the last one if none is."""
    out = texts[-1]
    for t in reversed(texts[:-1]):
        out = F.when(approximate_tokens(t) <= budget, t).otherwise(out)
    return out


def first_json(text: Column, bracket: str = "[") -> Column:
    """From the first opening bracket to the last closing one, if that is JSON; else null."""
    found = F.regexp_extract(text, r"(?s)\[.*\]" if bracket == "[" else r"(?s)\{.*\}", 0)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


#: Letters that only one of the two languages has.
_VIETNAMESE = "[ăâđêôơưàáảãạằắẳẵặầấẩẫậèéẻẽẹềếểễệìíỉĩịòóỏõọồốổỗộờớởỡợùúủũụừứửữựỳýỷỹỵ]"


def language(text: Column) -> Column:
    """Vietnamese or English; empty for a blank text."""
    return F.when(strip(text) == "", "").when(F.lower(text).rlike(_VIETNAMESE), "Vietnamese").otherwise("English")


#: Words that tell of time, matched anywhere in a text.
TEMPORAL = (
    "before", "prior to", "earlier than", "previously", "formerly", "once", "ahead of", "preceding", "by the time", "until", "after", "following", "subsequent to", "later", "thereafter", "then", "next", "henceforth", "from then on", "since",
    "while", "as", "when", "meanwhile", "simultaneously", "at the same time", "concurrently", "in the meantime", "during", "throughout",
    "until", "throughout", "all the while", "ever since", "as long as", "so long as", "from start to finish",
    "eventually", "gradually", "over time", "sooner or later", "in the long run", "before long", "by then", "by now", "from now on", "hence",
)
#: What shows that a question is for the whole video.
SUMMARY_CUES = ("summar", "overview", "recap", "tl;dr", "tldr", "what is this video about", "what's this video about", "describe the video", "describe this video", "tóm tắt", "tổng quan", "khái quát")
#: What shows that a question is not for a moment.
NON_MOMENT_CUES = ("summary", "summarize", "overview", "what is this video", "describe the video", "about")
#: Cues of the streams.
AUDIO_CUES = ("cheer", "applause", "whistle", "crowd", "roar", "clap", "shout", "music", "sound")
TEXT_CUES = ("say", "said", "says", "mention", "talk", "speak", "discuss", "explain", "tell")
OCR_CUES = ("text", "slide", "caption", "subtitle", "score", "scoreboard", "title")
#: Terms that tell how much a question is about what is heard, in the order in which they count.
HEARD = {
    "cheer": 1.0, "crowd": 0.9, "applau": 0.9, "roar": 1.0, "whistle": 0.9, "dunk": 0.8, "slam": 0.7, "goal": 0.8, "score": 0.6, "celebrat": 0.8,
    "shout": 0.7, "scream": 0.7, "fans": 0.7, "buzzer": 0.8, "ovation": 0.9, "loud": 0.5, "excite": 0.6, "yell": 0.7, "clap": 0.7, "win": 0.4,
}


def lexical_gate(query: Column) -> Column:
    """How much a question is about what is heard, 0 to 1: the largest weight so far and a tenth of each, term by term."""
    terms = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in HEARD.items()))
    step = lambda s, x: F.when(F.contains(F.lower(query), x["t"]), F.least(F.lit(1.0), F.greatest(s, x["w"]) + 0.1 * x["w"])).otherwise(s)
    return F.aggregate(terms, F.lit(0.0), step)


def moment_score(query: str, keywords: Column) -> Column:
    """Two for each word of the query in the joined keywords, one where it is there without its last letter, three if a keyword holds the query or lies in it."""
    q, hay = query.lower().strip(), F.lower(F.array_join(keywords, " "))
    score = F.lit(0)
    for term in q.split():
        loose = F.when(hay.contains(term[:-1]), 1).otherwise(0) if len(term) > 3 else F.lit(0)
        score += F.when(hay.contains(term), 2).otherwise(loose)
    whole = F.exists(keywords, lambda k: F.contains(k, F.lit(q)) | F.contains(F.lit(q), k))
    return score + F.when(whole, 3).otherwise(0)


def like_any(text: Column, asked: str) -> Column:
    """Whether a text holds ``asked`` whatever the case, with % and _ as in a LIKE pattern; everything holds an empty one."""
    return F.lit(True) if asked == "" else F.coalesce(text.ilike(f"%{asked}%"), F.lit(False))
