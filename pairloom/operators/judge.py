"""A language model as judge: prompts, an injected client, and parsed scores."""

from __future__ import annotations

import json
import random
import time
import urllib.request
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S

#: Fields of a reply.
FIELDS = ["final_score", "must_have_requirement_coverage", "experience_or_seniority_match", "responsibility_alignment", "nice_to_have_coverage", "domain_context_alignment"]
MAX_CHARS = 6000


def prompt(cv: Column, jd: Column, most: int = MAX_CHARS) -> Column:
    """Asks for the fields as JSON; each text is cut to ``most`` characters (all of it for 0 or less)."""
    cut = lambda c: F.coalesce(F.substring(c, 1, most) if most > 0 else c, F.lit(""))
    ask = "Rate from 0 to 100 how far the résumé shows what the job asks for. Reply with one JSON object of numbers named " + ", ".join(FIELDS) + ", and a one-sentence text named explanation."
    return F.concat(F.lit(ask + "\n\nJob:\n"), cut(jd), F.lit("\n\nRésumé:\n"), cut(cv))


class HttpClient:
    """Posts prompts to a local model server that answers in JSON mode; one request per call."""

    def __init__(self, model: str, url: str = "http://localhost:11434/api/generate", timeout: float = 120.0):
        self.model, self.url, self.timeout = model, url, timeout

    def __call__(self, text: str) -> str:
        body = {"model": self.model, "prompt": text, "stream": False, "format": "json", "options": {"temperature": 0}}
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            return json.loads(r.read())["response"]


class ReplyLog:
    """Replies by the hash of their prompt, one small file each, in a folder that all executors see (any Arrow file system)."""

    def __init__(self, folder: str):
        self.folder = folder

    def _place(self, digest: str):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        return files, f"{root}/{digest[:2]}", f"{root}/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> str | None:
        files, _, path = self._place(digest)
        if not files.get_file_info(path).is_file:
            return None
        with files.open_input_stream(path) as f:
            return json.loads(f.read())["reply"]

    def put(self, digest: str, reply: str) -> None:
        files, folder, path = self._place(digest)
        files.create_dir(folder, recursive=True)
        part = f"{path}.{uuid.uuid4().hex}"
        with files.open_output_stream(part) as f:
            f.write(json.dumps({"reply": reply}).encode())
        files.move(part, path)  # readers see a whole reply or none


def _patient(client: Callable[[str], str], attempts: int, wait: float) -> Callable[[str], str]:
    """The client, tried up to ``attempts`` times with pauses that double, each a random part longer."""

    def run(text: str) -> str:
        for i in range(attempts):
            try:
                return client(text)
            except Exception:  # noqa: BLE001  the last one is raised
                if i + 1 == attempts:
                    raise
                time.sleep(wait * 2**i * (1 + random.random()))  # noqa: S311
        raise AssertionError

    return run


def ask(df: DataFrame, keys: list[str], text: str, client: Callable[[str], str], log: str | None = None, workers: int = 1, attempts: int = 1, wait: float = 0.5, partitions: int | None = None) -> DataFrame:
    """(keys, reply, error): the client's reply to every row; a call that fails each time is a null with its error.

    Equal prompts are asked once.  Each task has ``workers`` requests under way and ``partitions`` bounds the
    tasks, so that the server sees at most their product.  With a ``log`` folder, replies are kept as they
    come and known prompts are not asked again, whether in a task that is tried again after a lost executor or in
    a later run; failures are not kept.  A null prompt is an error and is not asked.
    """
    digest = F.sha2(F.col(text).cast("binary"), 256)
    rows = df.select(*keys, digest.alias("_digest"), F.col(text).alias("_text"))
    prompts = rows.filter(F.col("_text").isNotNull()).select("_digest", "_text").dropDuplicates(["_digest"])
    prompts = prompts.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_digest")

    def run(batches):
        known, call = ReplyLog(log) if log else None, _patient(client, attempts, wait)

        def one(item):
            digest, prompt = item
            try:
                reply = known.get(digest) if known else None
                if reply is None:
                    reply = call(prompt)
                    if known:
                        known.put(digest, reply)
                return reply, None
            except Exception as e:  # the error is a result here
                return None, str(e) or type(e).__name__

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                out = list(pool.map(one, zip(b.column("_digest").to_pylist(), b.column("_text").to_pylist(), strict=True)))
                replies, errors = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([b.column("_digest"), pa.array(replies, pa.string()), pa.array(errors, pa.string())], ["_digest", "reply", "error"])

    said = prompts.mapInArrow(run, "_digest string, reply string, error string")
    met = rows.drop("_text").join(said, "_digest", "left")
    return met.select(*keys, "reply", F.when(F.col("_digest").isNull(), "no prompt").otherwise(F.col("error")).alias("error"))


def parsed(replies: DataFrame) -> DataFrame:
    """Adds the fields as shares of 1 and the explanation; a reply without JSON has nulls and an error."""
    schema = ", ".join([*(f"{f} string" for f in FIELDS), "explanation string"])
    out = replies.withColumn("_r", S.judge_json(F.col("reply"), schema))
    some = F.col("_r").isNotNull()
    error = F.coalesce("error", F.when(~some, F.concat(F.lit("no JSON in the reply: "), F.coalesce(F.substring("reply", 1, 500), F.lit("")))))
    fields = [F.when(some, S.percent_to_unit(F.col(f"_r.{f}"))).alias(f) for f in FIELDS]
    return out.select(*(c for c in replies.columns if c != "error"), *fields, F.col("_r.explanation").alias("explanation"), error.alias("error"))
