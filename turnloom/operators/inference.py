"""Model steps with the model left to the caller: recognition, translation, labelling.

Each takes a plain function on lists of texts. It runs in Arrow batches; make() is called once for each task, so a
model is loaded there and not sent with the plan. A call that fails gives what the step falls back to.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.operators import turns as turn_ops
from turnloom.workers import reachable

Make = Callable[[], Callable[[list[str]], list[str]]]


def per_text(text: Column, make: Make, fallback: Callable[[str], str]) -> Column:
    """The function's answer for each text, one batch at a time; if a batch fails, text by text."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in texts:
            asked = ["" if x is None else x for x in batch]
            try:
                yield pd.Series(model(asked), dtype=object)
            except Exception:  # the caller's model may raise anything
                yield pd.Series([_one(model, x, fallback) for x in asked], dtype=object)

    reachable()
    return F.pandas_udf(batches, "string")(text)


def _one(model: Callable[[list[str]], list[str]], text: str, fallback: Callable[[str], str]) -> str:
    try:
        return model([text])[0]
    except Exception:  # the caller's model may raise anything
        return fallback(text)


def length_scorer() -> Callable[[list[str]], list[str]]:
    """A stand-in for a labelling model: the label follows the turn's length."""
    return lambda prompts: [("positive", "neutral", "negative", "other")[len(p.rsplit("Speech turn: ", 1)[-1].rstrip("\n")) % 4] for p in prompts]


def identity() -> Callable[[list[str]], list[str]]:
    return lambda texts: texts


def label_turns(turns: DataFrame, make: Make, turns_before: int | None = 2, label_key: str = "sentiment_label", file_col: str = "file") -> DataFrame:
    """turns with a label on the client's non-blank turns: context, prompt, model, parsed answer, put back by index."""
    asked = turn_ops.context_window(turns, turns_before, file_col)
    prompt = F.array_join(F.transform(T.build_prompt(F.col("text"), F.col("context")), lambda m: m["content"]), "\n")
    answer = per_text(prompt, make, lambda _: "")
    labels = asked.select(file_col, "idx", answer.alias("raw")).select(file_col, "idx", T.parse_sentiment(F.col("raw")).alias("label"))
    return turn_ops.write_back(turns, labels, label_key, file_col)


def chat_client(url: str, model: str = "local", *, max_tokens: int = 12, temperature: float = 0.1, stop: Sequence[str] = ("\n",), timeout: float = 60.0) -> Callable[[], Callable[[str], str]]:
    """Makes a call to a chat server that speaks the usual completions protocol: messages as JSON in, the answer's text out."""

    def make() -> Callable[[str], str]:
        import json
        import urllib.request

        def call(messages: str) -> str:
            body = {"model": model, "messages": json.loads(messages), "max_tokens": max_tokens, "temperature": temperature, "stop": list(stop)}
            asked = urllib.request.Request(f"{url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": "Bearer local"})
            with urllib.request.urlopen(asked, timeout=timeout) as got:
                return json.load(got)["choices"][0]["message"]["content"] or ""

        return call

    return make


def ask_once(requests: DataFrame, make: Callable[[], Callable[[str], str]], store: str, *, concurrency: int = 8, tries: int = 4, wait: float = 0.5) -> DataFrame:
    """requests (with a column request) and the answer to each; equal requests are asked once, and what `store` has is not asked again.

    A task makes up to `concurrency` calls at a time. A call that fails is tried again after wait, 2 wait, 4 wait, ...; after `tries` it has no
    answer (null), and another run asks it again. Answers go to the folder `store` as Parquet (key, answer) before they are used.
    """
    spark = requests.sparkSession
    keyed = requests.withColumn("key", F.sha2("request", 256))
    schema = "key string, answer string"
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        known = spark.read.schema(schema).parquet(store)
        new = keyed.join(known, "key", "left_anti")
    else:
        new = keyed

    def answered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from concurrent.futures import ThreadPoolExecutor

        call = make()

        def patient(request: str) -> str | None:
            for k in range(tries):
                try:
                    return call(request)
                except Exception:  # the server may fail in any way
                    if k + 1 < tries:
                        time.sleep(wait * 2**k)
            return None

        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                yield pd.DataFrame({"key": frame["key"], "answer": pd.Series(list(pool.map(patient, frame["request"])), dtype=object)})

    reachable()
    asked = new.groupBy("key").agg(F.first("request").alias("request"))
    asked.mapInPandas(answered, schema).where(F.col("answer").isNotNull()).write.mode("append").parquet(store)
    known = spark.read.schema(schema).parquet(store).groupBy("key").agg(F.min("answer").alias("answer"))
    return keyed.join(known, "key", "left").drop("key")


def label_turns_by_requests(
    turns: DataFrame, make: Callable[[], Callable[[str], str]], store: str, turns_before: int | None = 2, label_key: str = "sentiment_label", file_col: str = "file", **options
) -> DataFrame:
    """label_turns() with one request a turn to a server (chat_client), see ask_once for options; a turn without an answer is labelled as an empty one."""
    asked = turn_ops.context_window(turns, turns_before, file_col)
    asked = asked.select(file_col, "idx", F.to_json(T.build_prompt(F.col("text"), F.col("context"))).alias("request"))
    got = ask_once(asked, make, store, **options)
    labels = got.select(file_col, "idx", T.parse_sentiment(F.coalesce("answer", F.lit(""))).alias("label"))
    return turn_ops.write_back(turns, labels, label_key, file_col)


def translate_turns(turns: DataFrame, make: Make = identity, most: int = 192, text_col: str = "text") -> DataFrame:
    """turns with their text translated chunk by chunk; a chunk that fails keeps its source text."""
    key = [c for c in turns.columns if c != text_col]
    chunks = turns.select("*", F.posexplode_outer(T.chunk_text(F.col(text_col), most)).alias("part", "chunk"))
    done = chunks.withColumn("chunk", F.when(F.col("chunk").isNotNull(), per_text(F.col("chunk"), make, lambda x: x)))
    parts = done.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("part", "chunk"))).alias("p"))
    return parts.select(*[T.rejoin_chunks(F.filter("p.chunk", lambda c: c.isNotNull())).alias(c) if c == text_col else F.col(c) for c in turns.columns])


def transcribe(segments: DataFrame, make: Callable[[], Callable[[pd.DataFrame], list[list[str]]]], keep: list[str]) -> DataFrame:
    """A row for each text that the recogniser finds in a segment (with its audio), on the segment's clock."""
    schema = ", ".join(f"{c} {segments.schema[c].dataType.simpleString()}" for c in keep) + ", part int, text string"

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            found = model(frame)
            rows = [(*row, i, text) for row, texts in zip(frame[keep].itertuples(index=False), found, strict=True) for i, text in enumerate(texts)]
            yield pd.DataFrame(rows, columns=[*keep, "part", "text"])

    reachable()
    return segments.mapInPandas(batches, schema)


def split_by_tokens(text: Column, make: Callable[[], tuple[Callable[[str], list[int]], Callable[[list[int]], str]]], most: int) -> Column:
    """array<string>: runs of at most `most` token ids, decoded and stripped, blank ones left out. make() gives (encode, decode).

    A text of no more tokens, or whose runs are all blank, stays as it is; null gives no piece.
    """

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = make()
        for batch in texts:
            yield pd.Series([[] if x is None else _runs(x, encode, decode, most) for x in batch], dtype=object)

    reachable()
    return F.pandas_udf(batches, "array<string>")(text)


def _runs(text: str, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], most: int) -> list[str]:
    ids = list(encode(text))
    if len(ids) <= most:
        return [text]
    return [s for i in range(0, len(ids), most) if (s := decode(ids[i : i + most]).strip())] or [text]


def token_count(text: Column, make: Callable[[], Callable[[str], list[int]]]) -> Column:
    """Number of tokens; where the tokenizer fails, of words. Null: 0."""

    def batches(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for batch in texts:
            yield pd.Series([int(_one(lambda t: [len(encode(t[0]))], x or "", lambda t: len(t.split()))) for x in batch], dtype="int64")

    reachable()
    return F.pandas_udf(batches, "long")(text)


def device_name(device: str) -> str:
    """cuda means its first device."""
    return "cuda:0" if str(device).strip().lower() == "cuda" else str(device)


def resolve_device(preferred: str | int | None, accelerators: int = 0) -> str:
    """auto: the first accelerator, or the cpu where there is none; a number: that accelerator, below 0 the cpu."""
    if preferred is None or str(preferred).strip().lower() in ("", "auto"):
        return "cuda:0" if accelerators else "cpu"
    try:
        number = int(preferred)
    except ValueError:
        return device_name(str(preferred))
    return f"cuda:{number}" if number >= 0 else "cpu"


def with_ffmpeg(folder: str, sample_rate: int = 16_000, channels: int = 1, program: str = "ffmpeg") -> Callable[[], Callable[[str], str | None]]:
    """An extractor for extract_audio(): the sound of a recording as WAV in a folder, both in any store that pyarrow reaches.

    The recording is streamed to a file of the task's own, as its index may lie at its end, and the sound goes to the folder under a hidden name
    first: a task that dies leaves no half of a file under a recording's name. A program that fails gives no sound.
    """

    def make() -> Callable[[str], str | None]:
        import os
        import shutil
        import subprocess
        import tempfile
        import uuid

        from turnloom.sources.documents import store_of

        def extract(path: str) -> str | None:
            (source, at), (target, base) = store_of(path), store_of(folder)
            stem = os.path.splitext(os.path.basename(path))[0]
            with tempfile.TemporaryDirectory() as own:
                recording, sound = f"{own}/recording{os.path.splitext(path)[1]}", f"{own}/sound.wav"
                with source.open_input_stream(at) as read, open(recording, "wb") as write:
                    shutil.copyfileobj(read, write, 1 << 20)
                call = [program, "-y", "-loglevel", "error", "-i", recording, "-vn", "-ac", str(channels), "-ar", str(sample_rate), sound]
                if subprocess.run(call, check=False).returncode:
                    return None
                target.create_dir(base)
                hidden = f"{base}/.{uuid.uuid4().hex}"
                with open(sound, "rb") as read, target.open_output_stream(hidden) as write:
                    shutil.copyfileobj(read, write, 1 << 20)
                target.move(hidden, f"{base}/{stem}.wav")
            return f"{folder.rstrip('/')}/{stem}.wav"

        return extract

    return make


def extract_audio(media: DataFrame, make: Callable[[], Callable[[str], str | None]], path_col: str = "path") -> DataFrame:
    """media with audio: the path itself for .wav, else what the extractor returns; null where it fails."""

    def batches(paths: Iterator[pd.Series]) -> Iterator[pd.Series]:
        extract = make()
        for batch in paths:
            yield pd.Series([_extracted(extract, p) for p in batch], dtype=object)

    reachable()
    return media.withColumn("audio", F.pandas_udf(batches, "string")(F.col(path_col)))


def _extracted(extract: Callable[[str], str | None], path: str | None) -> str | None:
    if path is None or path.lower().endswith(".wav"):
        return path
    try:
        return extract(path)
    except Exception:  # the caller's tool may raise anything
        return None


def diarize(media: DataFrame, make: Callable[[], Callable[[str, int], list[tuple[float, float, str]]]], speakers: int = 2, path_col: str = "audio") -> DataFrame:
    """(uri, start_s, dur_s, speaker) of every recording: who speaks when, by the caller's model. One that fails has no rows."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for frame in frames:
            rows = []
            for path in frame["path"].dropna():
                try:
                    found = model(path, speakers)
                except Exception:  # the caller's model may raise anything
                    continue
                uri = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows += [(uri, float(a), float(d), str(who)) for a, d, who in found]
            yield pd.DataFrame(rows, columns=["uri", "start_s", "dur_s", "speaker"])

    reachable()
    said = media.select(F.col(path_col).alias("path")).mapInPandas(batches, "uri string, start_s double, dur_s double, speaker string")
    return said.withColumn("uri", T.sanitize_uri(F.col("uri")))
