"""Calls of a model from inside tasks: patience, replay and a second call on invalid replies.

The model is a parameter: any function from a request to a reply. A request is
a prompt, an optional system text, the number of the sample and of the attempt,
and fixed settings; equal requests are one request and are called once.
"""

from __future__ import annotations

import contextlib
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.storage import shared_dir, written

#: Errors that tell of a crowded service, and the seconds to wait after them.
CROWDED = r"429|Too Many Requests|529|(?i:overloaded)"
CROWDED_WAIT = 60.0
#: How often a request is tried, and how many texts an embedding call takes.
TRIES = 10
TEXTS_A_CALL = 32
#: Keys of texts that a task remembers at a time.
SEEN = 1 << 20

Request = dict[str, object]


def wait_after(error: str, attempt: int) -> float:
    """Seconds before the next try: a minute for a crowded service, else 2, 4, 8, ..."""
    return CROWDED_WAIT if re.search(CROWDED, error) else float(2**attempt)


def patient(call: Callable[[], object], tries: int, sleep: Callable[[float], None]) -> tuple[object | None, str | None, int]:
    """Result, last error and number of calls; after the last failure no wait and no result."""
    why = None
    for attempt in range(1, tries + 1):
        try:
            return call(), None, attempt
        except Exception as e:  # noqa: BLE001
            why = str(e) or type(e).__name__
            if attempt < tries:
                sleep(wait_after(why, attempt))
    return None, why, tries


class Replays:
    """Replies by the key of their request, each a small file under a URI that all tasks can reach.

    A reply is put there before its task goes on, so a task that is run again
    reads it instead of calling. A file is written whole and then moved.
    """

    def __init__(self, uri: str) -> None:
        self.uri = uri if "://" in uri else f"file://{uri}"

    def _at(self, key: str) -> tuple[fs.FileSystem, str]:
        system, root = fs.FileSystem.from_uri(self.uri)
        return system, f"{root}/{key[:2]}/{key}"

    def get(self, key: str) -> str | None:
        system, path = self._at(key)
        try:
            with system.open_input_stream(path) as f:
                return f.read().decode()
        except FileNotFoundError:
            return None

    def put(self, key: str, reply: str) -> None:
        system, path = self._at(key)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(reply.encode())
        system.move(part, path)


@dataclass(frozen=True)
class Client:
    """A model and how it is called.

    ``call`` takes the request: ``prompt``, ``system``, ``sample``, ``attempt``
    and what is in ``settings`` (which are part of the request's key: name the
    model there). ``replays`` keeps replies between tasks and runs. ``spacing``
    is the pause between the calls of a task, in seconds.
    """

    call: Callable[[Request], str]
    settings: dict[str, object] = field(default_factory=dict)
    replays: Replays | None = None
    tries: int = TRIES
    spacing: float = 0.0
    sleep: Callable[[float], None] = time.sleep


def replays_of(df: DataFrame, name: str = "replies") -> Replays:
    """A store of replies in the shared folder, the same for every run with one name."""
    return Replays(f"{shared_dir(df.sparkSession)}/{name}")


def request_key(client: Client, *parts: Column) -> Column:
    """The sha256 of a request: its settings and its parts, with nulls told from empty texts."""
    fixed = F.lit(repr(sorted(client.settings.items())))
    return F.sha2(F.to_json(F.struct(fixed.alias("settings"), *[p.alias(f"p{i}") for i, p in enumerate(parts)]), {"ignoreNullFields": "false"}), 256)


def answered(rows: DataFrame, client: Client, prompt: str = "prompt", system: str | None = None, sample: str | None = None, attempt: int = 1) -> DataFrame:
    """The rows with ``reply``, ``error`` and ``n_calls`` of their request.

    Equal requests are called once and all their rows get the reply. A request
    that fails ``client.tries`` times has a null reply and its last error, never
    an exception. A null prompt is not asked: null reply, the error 'no
    prompt', no call. ``n_calls`` is 0 for a reply that was kept from before.

    The calls are made here and their replies written, so whatever is computed
    from the result, no call is repeated; with ``client.replays`` none is after
    a lost task either. Only requests and replies are shuffled, not the rows'
    other columns twice.
    """
    said = [F.col(prompt).cast("string"), (F.col(system) if system else F.lit(None)).cast("string"), (F.col(sample) if sample else F.lit(1)).cast("int"), F.lit(attempt)]
    keyed = rows.withColumn("_request", F.when(F.col(prompt).isNotNull(), request_key(client, *said)))
    names = ["prompt", "system", "sample", "attempt"]
    requests = keyed.filter(F.col("_request").isNotNull()).select("_request", *[c.alias(n) for c, n in zip(said, names)]).dropDuplicates(["_request"])
    replies = T.StructType([T.StructField("_request", T.StringType()), T.StructField("reply", T.StringType()), T.StructField("error", T.StringType()), T.StructField("n_calls", T.IntegerType())])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                key = row.pop("_request")
                kept = client.replays.get(key) if client.replays else None
                if kept is not None:
                    out.append((key, kept, None, 0))
                    continue
                request = client.settings | {k: None if v is None or v != v else v for k, v in row.items()}
                reply, why, n = patient(lambda r=request: client.call(r), client.tries, client.sleep)
                if reply is not None and client.replays:
                    client.replays.put(key, reply)
                out.append((key, reply, why, n))
                if client.spacing:
                    client.sleep(client.spacing)
            yield pd.DataFrame(out, columns=[f.name for f in replies])

    got = written(requests.mapInPandas(ask, replies), "replies").withColumnRenamed("_request", "_answers")
    met = keyed.join(got, F.col("_request") == F.col("_answers"), "left").drop("_answers")
    none = F.col("_request").isNull()
    return met.select(*rows.columns, "reply", F.when(none, "no prompt").otherwise(F.col("error")).alias("error"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"))


def answered_variants(texts: DataFrame, client: Client, text: str, variants: list[tuple[str, str]], prompt: Callable[[Column], Column]) -> DataFrame:
    """S18, L01 for several requests of one text: ``_text_key``, ``ask`` (the place in ``variants``), ``reply``, ``error`` of each distinct text that is not null.

    A variant is a system text and a suffix of the text; ``prompt`` makes the
    prompt of a text with its suffix. Equal requests are called once, as in
    ``answered``, but their prompts are made in the tasks that call: only the
    texts are shuffled, once, whatever the number of variants. Texts that differ
    by suffixes alone may make equal requests; they are dealt to one task, side
    by side. Copies of a text are dropped where they are read, as far as a task
    sees them.
    """
    ends = sorted({suffix for _, suffix in variants if suffix}, key=len, reverse=True)
    stem = F.regexp_replace(F.col(text), f"(?:{'|'.join(map(java_literal, ends))})+\\z", "") if ends else F.col(text)
    keyed = texts.filter(F.col(text).isNotNull()).select(F.sha2(text, 256).alias("_text_key"), F.xxhash64(stem).alias("_stem"), F.col(text).alias("_text"))

    def seen_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            new = []
            for k in b.column(0).to_pylist():
                new.append(k not in seen)
                seen.add(k)
            if len(seen) > SEEN:
                seen.clear()
            yield b.filter(pa.array(new, pa.bool_()))

    dealt = keyed.mapInArrow(seen_once, keyed.schema).repartition("_stem").sortWithinPartitions("_stem")
    asks = F.explode(F.array(*[F.struct(F.lit(i).alias("ask"), F.lit(system).alias("system"), F.lit(suffix).alias("suffix")) for i, (system, suffix) in enumerate(variants)])).alias("_a")
    said = dealt.select("_text_key", "_stem", "_text", asks).select("_text_key", "_stem", "_a.ask", prompt(F.concat("_text", "_a.suffix")).alias("prompt"), "_a.system")
    parts = [F.col("prompt").cast("string"), F.col("system").cast("string"), F.lit(1), F.lit(1)]
    asked = said.withColumn("_request", request_key(client, *parts))
    out = "_text_key string, ask int, reply string, error string"

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stem, known, told = None, {}, set()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False, name=None):
                text_key, own, place, said, system, request = r
                if own != stem:
                    stem, known, told = own, {}, set()
                if (text_key, place) in told:
                    continue
                told.add((text_key, place))
                if request not in known:
                    reply = client.replays.get(request) if client.replays else None
                    why = None
                    if reply is None:
                        sent = client.settings | {"prompt": said, "system": system, "sample": 1, "attempt": 1}
                        reply, why, _ = patient(lambda x=sent: client.call(x), client.tries, client.sleep)
                        if reply is not None and client.replays:
                            client.replays.put(request, reply)
                        if client.spacing:
                            client.sleep(client.spacing)
                    known[request] = (reply, why)
                rows.append((text_key, place, *known[request]))
            yield pd.DataFrame(rows, columns=["_text_key", "ask", "reply", "error"])

    return asked.mapInPandas(ask, out)


def java_literal(text: str) -> str:
    """A text as part of a regular expression that matches nothing else."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def answered_validly(rows: DataFrame, client: Client, reason: Callable[[Column], Column], prompt: str = "prompt", system: str | None = None, again: int = 1) -> DataFrame:
    """As ``answered``, and rows whose reply is not valid are asked ``again`` times more.

    ``reason`` makes of the reply why it is not valid, null if it is. The result
    has ``invalid``, that reason (or the error of a request without a reply),
    and ``n_asked``, how many requests were made; the last reply stands even if
    it is not valid. A null prompt is not asked again.
    """
    settled, open_ = None, rows
    for attempt in range(1, again + 2):
        got = answered(open_, client, prompt, system, attempt=attempt)
        why = F.when(F.col("reply").isNull(), F.col("error")).otherwise(reason(F.col("reply")))
        asked = F.when(F.col(prompt).isNull(), 0).otherwise(attempt)
        got = written(got.select(*rows.columns, "reply", "error", "n_calls", why.alias("invalid"), asked.alias("n_asked")), "judged")
        ready = F.col("invalid").isNull() | F.col(prompt).isNull() if attempt <= again else F.lit(True)
        settled = got.filter(ready) if settled is None else settled.unionByName(got.filter(ready))
        open_ = got.filter(~ready).select(*rows.columns)
        if attempt <= again and open_.isEmpty():
            break
    return settled


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], text: str, instruction: str | None = None, size: int = TEXTS_A_CALL, tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """The rows with ``embedding``; every distinct text is embedded once, ``size`` texts a call.

    With an ``instruction`` each text is sent as 'Instruct: ...\\nQuery: text'. Null and
    empty texts have a null embedding, as have the texts of a call that fails
    ``tries`` times. The calls are made here and their vectors written.
    """
    texts = rows.select(F.col(text).alias("_text")).filter(F.length("_text") > 0).distinct()
    schema = T.StructType([T.StructField("_text", T.StringType()), T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            listed = frame["_text"].tolist()
            for i in range(0, len(listed), size):
                part = listed[i : i + size]
                sent = [f"Instruct: {instruction}\nQuery: {t}" for t in part] if instruction else part
                got, _, _ = patient(lambda s=sent: embed(s), tries, sleep)
                vectors = [None] * len(part) if got is None else [[float(x) for x in v] for v in got]
                yield pd.DataFrame({"_text": part, "embedding": vectors}, columns=["_text", "embedding"])

    made = written(texts.mapInPandas(batches, schema), "embedded")
    return rows.join(made, F.col(text) == F.col("_text"), "left").drop("_text")


def forget(replays: Replays) -> None:
    """Remove a store of replies."""
    system, root = fs.FileSystem.from_uri(replays.uri)
    with contextlib.suppress(FileNotFoundError):
        system.delete_dir(root)
