"""Secret scan with multipart credential linking.

Strong spans (assignments, access keys, long hex runs) are reported as found. Weak parts - short keys, short values,
user names, bare keys, endpoints - are reported only when their complements stand near them: a weak secret needs an
identifier, a weak identifier needs a secret, an endpoint needs both, and a bare run of 40 key characters needs an
access key, each starting within `scope` code points in the same text. A weak identifier that holds an access key is
that key, and no part of its own.

A vectorised scan finds the parts of each text; the linking is a Spark interval join. Starts fall into bins as wide as
the scope; per text, role and bin only the first and last start are kept, and a part meets the bins beside its own.
The nearest start of a neighbouring bin decides exactly whether some part of that role is in reach, so the join never
makes a row for a pair of parts: it is linear in the parts even for one text full of them. Parts are keyed by the
digest of their text and made distinct before the shuffle, so thousands of copies count once. Only rows with a weak
part meet the linked spans: by a broadcast where few texts have some, else by a shuffle on (digest, salt).

Defined results: a null text counts as empty; an empty text has no spans and the digest of an empty string; repeated
rows and null ids keep a row each; texts are scanned whole; other columns are carried along by `redact`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apiloom.llm.common import cut, documents, in_batches, slices

#: Kinds in the order in which spans with one start are listed: three strong ones, then the linked ones.
KINDS = ["assign", "access", "hex", "ident", "secret", "endpoint"]
SCOPE = 256

_ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENT = re.compile(r"""(?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._/+-]{3,})""", re.A)
_WEAK = re.compile(r"""(?i:pwd|pass|passphrase|credential|private_?key|(?:secret_?)?access_?key|secret_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{4,})""", re.A)
#: A run of 40 key characters with a digit and letters of both cases.
_BARE = re.compile(r"(?<![A-Za-z0-9+/])(?=[a-z+/]*[A-Z0-9])(?=[A-Z0-9+/]*[a-z])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", re.A)
_URL = re.compile(r"""[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]+""", re.A)
#: User and password of an endpoint.
_LOGIN = re.compile(r"""://([^\s:/?#@"'<>]{1,256}):([^\s/?#@"'<>]{3,256})@""", re.A)
_HOST = re.compile(r"""(?i:host|server|endpoint)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.:/_-]{3,})""", re.A)

_PARTS = "array<struct<role:string,kind:string,weak:boolean,start:int,stop:int>>"


def find_parts(text: str) -> list[tuple[str, str, bool, int, int]]:
    """All parts of one text: (role, kind, weak, start, stop) in code points."""
    parts = []
    if ":" in text or "=" in text:
        for m in _ASSIGN.finditer(text):
            n = m.end(2) - m.start(2)
            if n >= 8:
                parts.append(("secret", "assign", False, m.start(), m.end()))
            elif n >= 4:
                parts.append(("secret", "secret", True, m.start(), m.end()))
        parts += [("ident", "ident", True, m.start(), m.end()) for m in _IDENT.finditer(text) if not _ACCESS.match(text, m.start(1))]
        parts += [("secret", "secret", True, m.start(), m.end()) for m in _WEAK.finditer(text)]
        parts += [("endpoint", "endpoint", True, m.start(), m.end()) for m in _HOST.finditer(text)]
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            strong = m.end() - m.start() >= 16
            parts.append(("access", "access" if strong else "ident", not strong, m.start(), m.end()))
        named = {stop for role, _, _, _, stop in parts if role == "secret"}
        parts += [("bare", "secret", True, m.start(), m.end()) for m in _BARE.finditer(text) if m.end() not in named]
    for m in _HEX.finditer(text):
        strong = m.end() - m.start() >= 32
        parts.append(("secret", "hex" if strong else "secret", not strong, m.start(), m.end()))
    if "://" in text:
        parts += [("endpoint", "endpoint", True, m.start(), m.end()) for m in _URL.finditer(text)]
        for m in _LOGIN.finditer(text):
            parts += [("ident", "ident", True, m.start(1), m.end(1)), ("secret", "secret", True, m.start(2), m.end(2))]
    return parts


def joined(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end of the spans by start, then by the order of the kinds."""
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted((a, KINDS.index(k), b, k) for a, b, k in spans))


def scan(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, the text's digest, counts and the joined string of strong spans, its SHA-256, and the parts of
    texts that hold a weak one (others need no linking)."""
    keep = list(keep or [])
    schema = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base", pa.string()), ("base_sha256", pa.string()), ("parts", pa.list_(pa.struct([("role", pa.string()), ("kind", pa.string()), ("weak", pa.bool_()), ("start", pa.int32()), ("stop", pa.int32())])))])
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"), F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("text_md5"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text"):
            out = []
            for text in batch.column("__text").to_pylist():
                parts = find_parts(text)
                base = [(a, b, k) for _, k, weak, a, b in parts if not weak]
                base_text = joined(base)
                kinds = [k for _, _, k in base]
                linked = [dict(role=r, kind=k, weak=w, start=a, stop=b) for r, k, w, a, b in parts] if len(base) < len(parts) else None
                out.append((kinds.count("assign"), kinds.count("access"), kinds.count("hex"), base_text, hashlib.sha256(base_text.encode()).hexdigest(), linked))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
            held = [i for i, name in enumerate(batch.schema.names) if name != "__text"]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in held] + columns, names=[batch.schema.names[i] for i in held] + schema.names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return in_batches(rows, run, f"{kept}, n_assign long, n_access long, n_hex long, base string, base_sha256 string, parts {_PARTS}")


def link_parts(scanned: DataFrame, *, scope: int = SCOPE) -> DataFrame:
    """The interval join: (text_md5, linked), with the reported weak spans of each text that has some."""
    parts = (
        scanned.where(F.col("parts").isNotNull())
        .select("text_md5", F.inline("parts"))
        .distinct()
        .withColumn("bin", F.floor(F.col("start") / scope).cast("int"))
    )
    bins = parts.groupBy("text_md5", "role", "bin").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    bins = bins.withColumnRenamed("role", "other")
    probes = parts.where("weak").withColumn("own", F.col("bin")).withColumn("bin", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    near = (
        ((F.col("bin") == F.col("own")))
        | ((F.col("bin") < F.col("own")) & (F.col("start") - F.col("last") <= scope))
        | ((F.col("bin") > F.col("own")) & (F.col("first") - F.col("start") <= scope))
    )
    met = probes.join(bins, ["text_md5", "bin"]).where(near & (F.col("role") != F.col("other")))
    roles = met.groupBy("text_md5", "role", "kind", "start", "stop").agg(F.collect_set("other").alias("others"))
    has = lambda *roles: F.arrays_overlap("others", F.array(*map(F.lit, roles)))
    complete = (
        F.when(F.col("role") == "secret", has("ident", "access"))
        .when(F.col("role") == "bare", has("access"))
        .when(F.col("role") == "ident", has("secret"))
        .when(F.col("role") == "access", has("secret", "bare"))
        .otherwise(has("ident", "access") & has("secret", "bare"))
    )
    return roles.where(complete).groupBy("text_md5").agg(F.collect_set(F.struct("start", "stop", "kind")).alias("linked"))


def _beside(rows: DataFrame, side: DataFrame, key: str, max_broadcast: int, salts: int = 16) -> DataFrame:
    """Left join with a side of one row for each key: broadcast when it has at most `max_broadcast` rows, else by a
    shuffle with the key salted, so that a third of the rows may share one key."""
    if side.limit(max_broadcast + 1).count() <= max_broadcast:
        return rows.join(F.broadcast(side), key, "left")
    spread = rows.withColumn("__salt", F.floor(F.rand(7) * salts).cast("int"))
    return spread.join(side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [key, "__salt"], "left").drop("__salt")


def _all_spans(base: DataFrame, linked: DataFrame, max_broadcast: int) -> DataFrame:
    """Adds `spans`: the strong spans and the linked ones, joined in order. Rows without a weak part join nothing."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    strong = F.transform(
        F.filter(F.split("base", ","), lambda s: F.length(s) > 0),
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"),
            F.split_part(s, F.lit(":"), F.lit(3)).cast("int").alias("stop"),
            F.split_part(s, F.lit(":"), F.lit(1)).alias("kind"),
        ),
    )
    ranked = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    text = F.array_join(F.transform(F.array_sort(ranked(F.concat(strong, "linked"))), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    plain = base.where(F.col("parts").isNull()).withColumn("spans", F.col("base"))
    met = _beside(base.where(F.col("parts").isNotNull()), linked, "text_md5", max_broadcast)
    return plain.unionByName(met.withColumn("spans", F.when(F.col("linked").isNull(), F.col("base")).otherwise(text)).drop("linked"))


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, max_broadcast: int = 100_000) -> DataFrame:
    """One row for each document: the id, counts, the digest of strong spans and all reported spans."""
    scanned = cut(scan(docs, text_col=text_col, keep=[id_col]))
    linked = cut(link_parts(scanned, scope=scope))
    return _all_spans(scanned, linked, max_broadcast).select(id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def without_spans(text: str, spans: str, mark: str) -> str:
    """The text with its spans (the joined string, in order of start) replaced; overlapping ones become one mark."""
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, text_col: str = "text", scope: int = SCOPE, mark: str = "[REDACTED]", max_broadcast: int = 100_000) -> DataFrame:
    """The same rows and columns, with every reported span of the text replaced by the mark.

    Texts with spans are few: their spans are broadcast when there are at most `max_broadcast` such texts, and joined by
    a salted shuffle otherwise. A text is rebuilt in one pass over its spans.
    """
    some = scan(docs, text_col=text_col).where((F.col("base") != "") | F.col("parts").isNotNull())
    scanned = cut(some.dropDuplicates(["text_md5"]))
    found = _all_spans(scanned, cut(link_parts(scanned, scope=scope)), max_broadcast).where("spans != ''")
    spans = cut(found.select(F.col("text_md5").alias("__md5"), F.col("spans").alias("__spans")))
    rows = _beside(docs.withColumn("__md5", F.md5(F.col(text_col))), spans, "__md5", max_broadcast)

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without_spans(t, s, mark) for t, s in zip(texts, spans, strict=True)], dtype=object)

    held = F.col("__spans").isNotNull()
    clean = F.when(held, cleaned(F.when(held, F.col(text_col)), "__spans")).otherwise(F.col(text_col))
    return rows.withColumn(text_col, clean).select(*docs.columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, weak parts linked within 256 code points."""
    return scan_secrets(documents(spark, sf_dir))
