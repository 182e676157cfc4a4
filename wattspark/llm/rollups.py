"""Token counts: rollups that signed deltas maintain.

A batch of changes holds inserts, deletes and revisions of counted documents. It becomes additive partial totals by source,
language and tokenizer version, written under the batch's own name; writing a batch again replaces the same rows by themselves, so a
commit is idempotent and a lost job can be run again. Only batches whose writing ended count. Totals are the sums over batches;
compaction folds batches into one base that names them, and a batch that a base names is never counted again.

Nulls: a null source, language or tokenizer is a group of its own; a null count is 0. Repeated changes within a batch each count (a log
has one row a change). An empty batch commits and changes nothing; an empty table gives no rows. Groups whose documents have all gone
stay, with zeros, until compaction leaves them out. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from . import tokens as TK

KEYS = ("source", "lang", "tokenizer")
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed rows of changes(op, source, lang, tokenizer, n_tokens[, old_source, old_lang, old_tokenizer, old_tokens][, times]).

    op is insert, delete, or revise; a revision takes the old count out of the old group and puts the new one in. Another op raises.
    times: how many equal changes a row stands for, one without it or where it is null.
    """
    times = (F.coalesce("times", F.lit(1)) if "times" in changes.columns else F.lit(1)).cast("long")
    signed = lambda sign, count, prefix="": F.struct(*(F.col(prefix + k).alias(k) for k in KEYS), (sign * times).alias("n_docs"), (sign * times * F.coalesce(count, F.lit(0)).cast("long")).alias("n_tokens"))
    rows = F.when(F.col("op") == "insert", F.array(signed(1, "n_tokens"))).when(F.col("op") == "delete", F.array(signed(-1, "n_tokens")))
    if "old_tokens" in changes.columns:
        rows = rows.when(F.col("op") == "revise", F.array(signed(-1, "old_tokens", "old_"), signed(1, "n_tokens")))
    unknown = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce("op", F.lit("null")))).cast("array<struct<source:string,lang:string,tokenizer:string,n_docs:bigint,n_tokens:bigint>>")
    return changes.select(F.explode(rows.otherwise(unknown)).alias("d")).select("d.*")


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """A rollup in a folder (a URI) that driver and executors share."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _parts(self) -> list[str]:
        fs, at = K.filesystem(self.folder)
        from pyarrow.fs import FileSelector

        found = fs.get_file_info(FileSelector(at, allow_not_found=True))
        return sorted(f.base_name for f in found if f.type.name == "Directory" and fs.get_file_info(f"{f.path}/_SUCCESS").type.name == "File")

    def _bases(self) -> list[tuple[str, set[str]]]:
        out = []
        fs, at = K.filesystem(self.folder)
        for name in self._parts():
            if name.startswith("base-"):
                with fs.open_input_stream(f"{at}/{name}.json") as f:
                    out.append((name, set(json.loads(f.read()))))
        return out

    def batches(self) -> list[str]:
        """Committed batches, those in a base included."""
        folded = set().union(*(b for _, b in self._bases()))
        return sorted(folded | {p.removeprefix("batch-") for p in self._parts() if p.startswith("batch-")})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch; False if it was committed before, and then nothing is done."""
        if batch in self.batches():
            return False
        summed(deltas(changes)).write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        bases = self._bases()
        base = max(bases, key=lambda b: len(b[1]), default=(None, set()))
        names = [base[0]] * bool(base[0]) + [p for p in self._parts() if p.startswith("batch-") and p.removeprefix("batch-") not in base[1]]
        if not names:
            return self.spark.createDataFrame([], TOTALS)
        return summed(self.spark.read.schema(TOTALS).parquet(*(f"{self.folder}/{n}" for n in names)))

    def compact(self) -> None:
        """Writes one base of all committed batches; its list of batches is written before its rows count."""
        done = self.batches()
        name = f"base-{len(done):08d}"
        rows = self.totals().where("n_docs != 0 or n_tokens != 0")
        fs, at = K.filesystem(self.folder)
        fs.create_dir(at, recursive=True)
        with fs.open_output_stream(f"{at}/{name}.json") as f:
            f.write(json.dumps(done).encode())
        if name not in self._parts():
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}")


def counted(docs: DataFrame, tokenizers: dict[str, tuple[str, bool, bool]]) -> DataFrame:
    """doc_id, source, lang, the SHA-256 of the text, and its ids under each tokenizer: name to (file, keep_space, lower) of tokens.encoder()."""

    def run(batches):
        encoders = {name: TK.encoder(*how) for name, how in tokenizers.items()}
        for batch in batches:
            for part in K.slices(batch, "text"):
                column = part.column("text")
                texts = column.cast(pa.large_binary()).fill_null(b"").to_pylist()
                n = {name: pa.array(np.diff(e.encode(column)[1])) for name, e in encoders.items()}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "source": part.column("source"), "lang": part.column("lang"), "digest": [hashlib.sha256(t).hexdigest() for t in texts], **n})

    schema = "doc_id long, source string, lang string, digest string, " + ", ".join(f"`{name}` long" for name in tokenizers)
    return docs.select("doc_id", "source", "lang", "text").mapInArrow(K.tidy(run), schema)


def repeated(docs: DataFrame, counts: list[str]) -> DataFrame:
    """Documents that have a text which another has: (source, lang, counts, times), times documents alike a row.

    Of each text, the document with the smallest (doc_id, source, lang) is not among them; nulls come last, and of equal ones one stays.
    Equal texts of one source and language are counted before the join, so that a text of any number of copies has a few rows in it.
    """
    groups = docs.groupBy("digest", "source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in counts))
    place = F.struct(*(x for c in ("doc_id", "source", "lang") for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))))
    first = groups.groupBy("digest").agg(F.min(place).alias("first"))
    left = groups.join(first, "digest").withColumn("times", F.col("n") - place.eqNullSafe(F.col("first")).cast("long"))
    return left.where("times > 0").select("source", "lang", *counts, "times")


#: Registered tokenizers: name to file, whether white space is part of its chunks, and whether it lower-cases.
TOKENIZERS = {"byte_bpe_50k": ("byte_bpe_50k.json", True, False), "word_bpe_49k": ("word_bpe_49k.json", False, True)}


def op9_token_rollups(spark, sf_dir):
    """Totals of all documents after three batches: inserts under two tokenizers; a new version of the word tokenizer, which adds an end
    id, as revisions; deletes of documents whose text another one has (see repeated()). Later batches come twice, as after a lost job."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = K.saved(counted(docs, {name: (TK.tokenizer_path(file), *how) for name, (file, *how) in TOKENIZERS.items()}), spark, "token-counts")
    rollup = Rollup(spark, K.shared_dir(spark, "token-rollup"))
    byte, word = TOKENIZERS
    under = lambda *rows: F.explode(F.array(*(F.struct(F.lit(name).alias("tokenizer"), n.alias("n_tokens")) for name, n in rows))).alias("c")
    rollup.commit("1", docs.select(F.lit("insert").alias("op"), "source", "lang", under((f"{byte}@1", F.col(byte)), (f"{word}@1", F.col(word)))).select("op", "source", "lang", "c.*"))
    revised = docs.select(F.lit("revise").alias("op"), "source", "lang", F.lit(f"{word}@2").alias("tokenizer"), (F.col(word) + 1).alias("n_tokens"), F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(f"{word}@1").alias("old_tokenizer"), F.col(word).alias("old_tokens"))
    gone = repeated(docs, [byte, word]).select(F.lit("delete").alias("op"), "source", "lang", "times", under((f"{byte}@1", F.col(byte)), (f"{word}@2", F.col(word) + 1))).select("op", "source", "lang", "times", "c.*")
    for _ in range(2):
        rollup.commit("2", revised)
        rollup.commit("3", gone)
    rollup.compact()
    return rollup.totals()
