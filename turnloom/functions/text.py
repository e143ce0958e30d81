"""Column functions on speakers, labels, clocks and turn texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the two roles, the labels, and the texts of the labelling prompt.
CLIENT_TOKENS = ("client", "patient", "pr", "p")
THERAPIST_TOKENS = ("therapist", "in", "therapeut", "therapeutin", "t")
LABELS = ("positive", "neutral", "negative", "other")
SENTIMENTS = ("positive", "neutral", "negative")
SYSTEM_PROMPT = (
    "You are an expert clinical psychologist coding transcripts. "
    "Your task is to classify the emotional sentiment of a single participant speech turn "
    "from a relationship interview — a structured attachment-relationship reflection where "
    "the client describes the quality of their close personal relationships. "
    "Reply with exactly one word: positive, neutral, negative, or other. "
    "Use 'other' when the turn is not about the relationship itself (e.g. "
    "technical issues with the video call, scheduling, or small talk unrelated to "
    "attachment). Output nothing else."
)
FEW_SHOT = (
    (
        "She was always there for me when I came home from school. I felt really safe and loved in that relationship.",
        "positive",
    ),
    (
        "I remember my partner holding my hand during a really hard time. It made me feel like I could count on them no matter what.",
        "positive",
    ),
    ("We didn't really talk much about feelings. The relationship was just, you know, normal I guess.", "neutral"),
    ("I would say we got along okay. There were good days and bad days, nothing that really stands out.", "neutral"),
    ("He had a terrible temper. When he got angry I would hide in my room. I never felt safe in that relationship.", "negative"),
    ("There were a lot of arguments. I felt like I was always walking on eggshells around her, afraid of being rejected.", "negative"),
    ("Sorry, I think my connection dropped for a second. Can you hear me now?", "other"),
    ("Hold on, let me adjust my camera. The Teams window is a bit glitchy today.", "other"),
)
#: Unicode white space, as Python strips it.
_SPACE = r"(?U)\s"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+$", "")


def canonical_speaker(name: Column) -> Column:
    """client, therapist or other; a name that fits both is the client. Null: other."""
    s = F.translate(F.lower(strip(F.coalesce(name, F.lit("")))), "_- ", "")
    client = s.isin(*CLIENT_TOKENS) | s.contains("client") | s.contains("patient")
    therapist = s.isin(*THERAPIST_TOKENS) | s.contains("therap")
    return F.when(client, "client").when(therapist, "therapist").otherwise("other")


def parse_sentiment(raw: Column) -> Column:
    """The first word of a model's answer that is a label, else other."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(raw, F.lit(""))), r"[^a-z\s]", " "), r"\s+")
    return F.coalesce(F.get(F.filter(words, lambda w: w.isin(*LABELS)), F.lit(0)), F.lit("other"))


def patient_code(file_name: Column) -> Column:
    """Upper-cased code after translate_, or null."""
    code = F.regexp_extract(file_name, r"^translate_([A-Za-z0-9]+)", 1)
    return F.nullif(F.upper(code), F.lit(""))


def coerce_ms(value: Column, default: Column) -> Column:
    """Milliseconds of a text: whole numbers as they are, anything else the default."""
    trimmed = strip(value)
    return F.when(trimmed.rlike(r"^-?\d+$"), trimmed.try_cast("bigint")).otherwise(default)


def coerce_json_ms(value: Column, default: Column) -> Column:
    """Milliseconds of a JSON value (variant): numbers cut to whole ones, true 1 and false 0, texts as coerce_ms; null,
    absent or anything else: the default."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    whole = F.when(F.abs(number) < 9e18, F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint"))
    out = F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), whole)
    out = out.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
    return F.coalesce(out.when(kind == "STRING", coerce_ms(F.try_variant_get(value, "$", "string"), default)), default)


def json_text(value: Column, absent: str) -> Column:
    """The text of a JSON value (variant); null is the word None, as its text is elsewhere; absent: as given."""
    return F.when(value.isNull(), absent).when(F.is_variant_null(value), "None").otherwise(F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))


def model_limits(model_max: int | None, most_in: int | None = 192, most_new: int | None = 256) -> tuple[int, int]:
    """Tokens that go into a model and may come out. A model's length that is missing, not positive or above 16384 counts as
    512; 32 of it are kept free; no more than 256 come out."""
    known = model_max if isinstance(model_max, int) and 0 < model_max <= 16384 else 512
    room = max(32, known - 32)
    return min(most_in or room, room), min(most_new or 256, 256)


def clamp_span(start: Column, end: Column) -> tuple[Column, Column]:
    """Start no less than 0, end no less than start; a missing end is the start."""
    lo = F.greatest(F.coalesce(start, F.lit(0)), F.lit(0))
    return lo, F.greatest(F.coalesce(end, lo), lo)


def sanitize_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, rf"{_SPACE}+", "_")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), rf"{_SPACE}+"), lambda w: w != "")


def token_len(text: Column) -> Column:
    """Number of words: what stands in for tokens without a tokenizer."""
    return F.size(words_of(text))


def split_oversized(text: Column, most: int) -> Column:
    """array<string> of runs of at most `most` words. A text is split once, not once for each run."""

    def runs(words: Column) -> Column:
        n = F.size(words)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(most))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(most)), " "))

    return F.transform(F.array(words_of(text)), runs)[0]


def chunk_text(text: Column, most: int) -> Column:
    """array<string>: a text of up to `most` words is one chunk; a longer one is cut at sentence ends, sentences
    that are too long are cut by words, and pieces are packed greedily. Null and blank texts: no chunk.

    The words of each piece are counted once; packing adds numbers and slices the pieces at the end.
    """
    whole = strip(F.coalesce(text, F.lit("")))
    sentences = F.filter(F.split(whole, rf"(?<=[.!?]){_SPACE}+"), lambda s: s != "")
    counted = F.transform(sentences, lambda s: F.struct(s.alias("s"), token_len(s).alias("n")))
    long = lambda x: F.transform(split_oversized(x["s"], most), lambda s: F.struct(s.alias("s"), token_len(s).alias("n")))
    pieces = F.flatten(F.transform(counted, lambda x: F.when(x["n"] > most, long(x)).otherwise(F.array(x))))
    start = F.struct(F.array().cast("array<int>").alias("from"), F.lit(0).alias("open"), F.lit(0).alias("i"))

    def step(acc: Column, piece: Column) -> Column:
        fresh = (acc["i"] == 0) | (acc["open"] + piece["n"] > most)
        return F.struct(
            F.when(fresh, F.array_append(acc["from"], acc["i"])).otherwise(acc["from"]).alias("from"),
            F.when(fresh, piece["n"]).otherwise(acc["open"] + piece["n"]).alias("open"), (acc["i"] + 1).alias("i"),
        )

    def packed(all_pieces: Column) -> Column:
        bounds = F.aggregate(all_pieces, start, step, lambda acc: F.array_append(acc["from"], acc["i"]))
        return F.transform(F.array(F.struct(all_pieces["s"].alias("p"), bounds.alias("b"))), lambda x: F.transform(
            F.slice(x["b"], 1, F.size(x["b"]) - 1), lambda lo, k: F.array_join(F.slice(x["p"], lo + 1, F.get(x["b"], k + 1) - lo), " ")))[0]

    one = F.transform(F.array(pieces), packed)[0]
    return F.when(whole == "", F.array().cast("array<string>")).when(token_len(whole) <= most, F.array(whole)).otherwise(one)


def rejoin_chunks(chunks: Column) -> Column:
    return F.array_join(F.filter(F.transform(chunks, strip), lambda c: c != ""), " ")


def build_prompt(text: Column, context: Column, examples: Sequence[tuple[str, str]] = FEW_SHOT, system: str = SYSTEM_PROMPT) -> Column:
    """array<struct<role, content>>: system, examples in turn, then the turn after its numbered context."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    shown = [message("system", F.lit(system))]
    for example, label in examples:
        shown += [message("user", F.lit(f"Speech turn: {example}")), message("assistant", F.lit(label))]
    lines = F.transform(context, lambda s, i: F.concat(F.lit("Previous snippet "), (i + 1).cast("string"), F.lit(": "), s))
    block = F.when(F.size(context) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    return F.array(*shown, message("user", F.concat(block, F.lit("Speech turn: "), text, F.lit("\n"))))
