"""Token counts as delta-maintained rollups.

A batch is a set of signed rows: +1 and a document's tokens for an insert, -1 and minus its tokens for a delete,
both for a revised count. A commit sums the batch by source, language and tokenizer version and writes that sum
once under the batch's name; totals are the sum of all committed batches. A batch is written beside its place and
then renamed, so of two writers one commits; a name that is committed already is left alone, so a replay after a
lost driver changes nothing; and a commit that broke off leaves nothing that counts. Old batches can be folded into
one without changing any total; a folded batch stays committed.

Tokenizer versions are public vocabularies; each counts whole texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows
from .tokens import encoder

DIMENSIONS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Most letters of a batch's quoted name, so that file systems take it.
LONGEST_NAME = 200

Counter = Callable[[list[str | None]], list[int]]


def word_bpe(path: str | None = None) -> Counter:
    own = encoder(path)
    return lambda texts: [len(ids) // 4 for ids in own.encode(texts)]


def byte_bpe(path: str | None = None) -> Counter:
    import base64

    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    own = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda texts: [len(own.encode_ordinary(t)) if t else 0 for t in texts]


#: Tokenizer versions: each makes, once in a task, a function from texts to their numbers of tokens.
TOKENIZERS: dict[str, Callable[[], Counter]] = {"word_bpe_49k": word_bpe, "byte_bpe_50k": byte_bpe}


def counted(docs: DataFrame, tokenizers: Mapping[str, Callable[[], Counter]] = TOKENIZERS, text: str = "text") -> DataFrame:
    """docs exploded to one row for each tokenizer version: its columns but the text, tokenizer and tokens.

    A null or empty text has no tokens; texts are counted whole; repeated rows repeat; an empty docs gives no rows.
    Columns of docs named tokenizer or tokens give way.
    """
    kept = [c for c in docs.columns if c not in (text, "tokenizer", "tokens")]
    kinds = docs.schema

    def make():
        own = {name: start() for name, start in tokenizers.items()}

        def f(*lists):
            *others, texts = lists
            return [*others, list(zip(*(count(texts) for count in own.values()), strict=True))]

        return f

    fields = ", ".join([*(f"`{c}` {kinds[c].dataType.simpleString()}" for c in kept), "`__tokens` array<long>"])
    made = map_rows(docs.select(*kept, text), [*kept, text], fields, make)
    pairs = F.arrays_zip(F.array(*map(F.lit, tokenizers)).alias("tokenizer"), F.col("__tokens").alias("tokens"))
    return made.select(*kept, F.inline(pairs).alias("tokenizer", "tokens"))


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Rows (source, lang, tokenizer, tokens) as inserts (sign 1) or deletes (sign -1). Rows without tokens (null)
    count as documents without any; null sources and languages are values of their own."""
    tokens = F.coalesce("tokens", F.lit(0)).cast("long")
    return rows.select(*DIMENSIONS, F.lit(sign).cast("long").alias("docs"), (tokens * sign).alias("tokens"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of old leave, those of new come in their place."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """A folder of committed batches, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _place(self, batch: str) -> str:
        """A batch's folder: its name, quoted. An empty or very long name is a ValueError."""
        name = quote(batch, safe="")
        if not 0 < len(name) <= LONGEST_NAME:
            raise ValueError(f"a batch's name must have 1 to {LONGEST_NAME} letters, quoted: {batch[:40]!r}")
        return f"{self.path}/batch={name}"

    def committed(self, batch: str) -> bool:
        """Whether the batch counts: by itself or within a folded one."""
        return self._files().exists(self._at(self._place(batch))) or batch in self._folded()

    def _listed(self, prefix: str) -> list[str]:
        files = self._files()
        if not files.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._at(self.path))]
        return sorted(n.removeprefix(prefix) for n in names if n.startswith(prefix))

    def _folded(self) -> set[str]:
        """Names of the batches that folded ones hold."""
        lists = self._listed("folded=")
        return {r[0] for r in self.spark.read.schema("name string").parquet(*(f"{self.path}/folded={n}" for n in lists)).collect()} if lists else set()

    def _move(self, source: str, target: str) -> bool:
        """Rename a folder; False if there is one of that name. Atomic where the file system's renaming is."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(target).toUri(), conf).rename(self._at(source), self._at(target), none)
        except Exception:
            if not self._files().exists(self._at(target)):
                raise
            self._files().delete(self._at(source), True)
            return False
        return True

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether this call committed the batch; a committed one is not even computed again.

        changes: (source, lang, tokenizer, docs, tokens); an empty set is a batch without effect.
        """
        place = self._place(batch)
        if self.committed(batch):
            return False
        sums = changes.groupBy(*DIMENSIONS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        sums.filter("docs <> 0 or tokens <> 0").write.parquet(draft)
        return self._move(draft, place)

    def batches(self) -> list[str]:
        return [unquote(n) for n in self._listed("batch=")]

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches, without groups where both are 0."""
        names = self.batches()
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*(self._place(b) for b in names))
        sums = rows.groupBy(*DIMENSIONS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 or tokens <> 0")

    def fold(self, path: str) -> Rollup:
        """The same totals as one batch of a new folder, in which all batches held here stay committed."""
        folded, names = Rollup(self.spark, path), sorted({*self.batches(), *self._folded()})
        mark = uuid.uuid4().hex
        # names first: a fold that breaks off leaves no totals that could be counted twice
        self.spark.createDataFrame([(n,) for n in names], "name string").write.parquet(f"{folded.path}/folded={mark}")
        folded.commit(f"fold-{mark}", self.totals())
        return folded
