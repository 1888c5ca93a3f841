"""Terms and statements in canonical Turtle."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocabulary import LABEL, TYPE, XSD, prefixes

SAFE = r"^[A-Za-z0-9_]([A-Za-z0-9_.\-]*[A-Za-z0-9_\-])?$"


def abbreviate(iri: Column, base: str) -> Column:
    """prefix:local under the longest namespace that leaves a safe local name, else the IRI in angle brackets."""
    out = F.concat(F.lit("<"), iri, F.lit(">"))
    for p, ns in sorted(prefixes(base).items(), key=lambda x: len(x[1])):
        local = F.substring(iri, len(ns) + 1, 1 << 30)
        out = F.when(F.startswith(iri, F.lit(ns)) & local.rlike(SAFE), F.concat(F.lit(p + ":"), local)).otherwise(out)
    return out


def escape(c: Column) -> Column:
    """String escapes of a literal; other control characters as \\u00XX. Most literals need none."""
    whole = c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        c = F.replace(c, F.lit(a), F.lit(b))
    for n in [*range(8), 11, *range(14, 32), 127]:
        c = F.replace(c, F.lit(chr(n)), F.lit(f"\\u{n:04X}"))
    return F.when(whole.rlike(r'[\x00-\x1F\x7F"\\]'), c).otherwise(whole)


def term(kind: Column, value: Column, lang: Column, datatype: Column, base: str) -> Column:
    text = F.concat(F.lit('"'), escape(value), F.lit('"'))
    typed = F.when(datatype.isNotNull() & (datatype != XSD + "string"), F.concat(text, F.lit("^^"), abbreviate(datatype, base))).otherwise(text)
    return F.when(kind == "iri", abbreviate(value, base)).otherwise(F.when(lang.isNotNull(), F.concat(text, F.lit("@"), lang)).otherwise(typed))


def predicate(p: Column, base: str) -> Column:
    return F.when(p == TYPE, F.lit("a")).otherwise(abbreviate(p, base))


def rank(p: Column) -> Column:
    return F.when(p == TYPE, 0).when(p == LABEL, 1).otherwise(2)


def blocks(quads: DataFrame, base: str) -> DataFrame:
    """(file, subject, block): each subject's statements in canonical order as one Turtle block."""
    key = F.struct(
        rank(F.col("predicate")).alias("r"), "predicate", F.when(F.col("o_kind") == "iri", 0).otherwise(1).alias("k"), "o_value",
        F.coalesce("o_lang", F.lit("")).alias("l"), F.coalesce("o_type", F.lit("")).alias("d"),
        F.concat(predicate(F.col("predicate"), base), F.lit(" "), term(F.col("o_kind"), F.col("o_value"), F.col("o_lang"), F.col("o_type"), base)).alias("text"),
    )
    # keys made before the aggregate are compiled code; its sort compares the hash first, as all subjects begin alike
    rows = quads.select("file", "subject", F.xxhash64("subject").alias("_h"), key.alias("_key")).groupBy("_h", "file", "subject").agg(F.array_sort(F.collect_set("_key")).alias("s"))
    return rows.select("file", "subject", F.concat(abbreviate(F.col("subject"), base), F.lit(" "), F.array_join(F.transform("s", lambda x: x["text"]), " ;\n  "), F.lit(" .")).alias("block"))


def _head(base: str) -> str:
    return "\n".join(f"@prefix {p}: <{ns}> ." for p, ns in prefixes(base).items()) + "\n"


def digests(quads: DataFrame, base: str) -> DataFrame:
    """(file, digest, n_chars) of the texts of :func:`files`, which pass through one task a file, sorted, and are never held whole."""
    head = _head(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, sha, n = None, hashlib.sha256(), 0

        def end() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file]), pa.array([sha.hexdigest()]), pa.array([n])], names=["file", "digest", "n_chars"])

        for b in batches:
            names = b.column("file").dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if (own := names.dictionary[int(code[lo])].as_py()) != file:
                    if file is not None:
                        yield end()
                    file, sha, n = own, hashlib.sha256(head.encode()), len(head)
                text = b.column("text").slice(lo, hi - lo).cast(pa.large_string())
                n += pc.sum(pc.utf8_length(text)).as_py()
                at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + hi - lo + 1]
                sha.update(memoryview(text.buffers()[2])[at[0] : at[-1]])
        if file is not None:
            yield end()

    rows = blocks(quads, base).select("file", "subject", F.concat(F.lit("\n"), "block", F.lit("\n")).alias("text"))
    return rows.repartition("file").sortWithinPartitions("file", "subject").select("file", "text").mapInArrow(run, "file string, digest string, n_chars bigint")


def files(quads: DataFrame, base: str) -> DataFrame:
    """(file, text): the prefix block, then the subjects' blocks by IRI, each after an empty line."""
    head = _head(base)
    one = blocks(quads, base).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("subject", "block"))).alias("b"))
    return one.select("file", F.concat(F.lit(head), F.array_join(F.transform("b", lambda x: F.concat(F.lit("\n"), x["block"], F.lit("\n"))), "")).alias("text"))
