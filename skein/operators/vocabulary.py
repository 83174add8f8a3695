"""Terms: frequencies, document frequencies, vocabularies and TF-IDF vectors, in long form."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..arrays import mapped, put
from ..checkpoints import checkpointed, release, shared_path
from ..functions.porter import stem as porter_stem
from ..functions.text import ngrams, stemmed, tokens
from .relational import split_at

#: A list of so many phrases is matched within the row, a longer one by a join.
LISTED = 1000


def term_frequency(docs: DataFrame, key: str = "urlid", text: str = "content", stopwords: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
    """(key, term, tf).  Counted within map tasks before the shuffle.

    ``dealt``: the texts are shuffled by key instead, which are fewer bytes, and
    counted where they are; for a plan that needs the counts once, as each other
    use would count again.
    """
    if dealt:
        docs = docs.select(key, text).repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    return docs.select(key, F.explode(tokens(F.col(text), stopwords)).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(tf: DataFrame) -> DataFrame:
    """(term, df): a row of ``tf`` is a document and a term once.

    The sum mentions tf, so that a plan that needs both has the shuffle of ``tf`` once.
    """
    return tf.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df"))


def stem_terms(tf: DataFrame, key: str = "urlid") -> DataFrame:
    """``tf`` over stems.  The stemmer sees each distinct term once."""
    stems = tf.select("term").distinct().withColumn("stem", stemmed("term"))
    return tf.join(stems, "term").groupBy(key, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def weight(tf: Column, df: Column, n: Column) -> Column:
    return F.log2(tf + 1) * (F.log2(n + 1) - F.log2(df + 1))


@dataclass
class Vocabulary:
    """Document frequencies and the number of documents they are of."""

    terms: DataFrame
    documents: DataFrame

    @staticmethod
    def fit(tf: DataFrame, docs: DataFrame) -> Vocabulary:
        return Vocabulary(document_frequency(tf), docs.agg(F.count(F.lit(1)).alias("n_docs")))

    @staticmethod
    def read(spark: SparkSession, path: str) -> Vocabulary:
        return Vocabulary(spark.read.parquet(f"{path}/terms").select(F.col("word").alias("term"), F.col("dftext").alias("df")), spark.read.parquet(f"{path}/documents"))

    def commit(self, path: str) -> None:
        """Write (rowid, word, dftext), replacing what was there.  Ids count from 1 in the order of the words."""
        ordered = checkpointed(self.terms.repartitionByRange("term").sortWithinPartitions("term").withColumn("at", F.monotonically_increasing_id()))
        part, number = F.shiftrightunsigned("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
        starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))  # a row for each partition
        numbered = ordered.withColumn("part", part).join(F.broadcast(starts), "part")
        numbered.select((F.col("start") + number + 1).alias("rowid"), F.col("term").alias("word"), F.col("df").alias("dftext")).write.mode("overwrite").parquet(f"{path}/terms")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")


def tfidf(tf: DataFrame, vocabulary: Vocabulary, key: str = "urlid") -> DataFrame:
    """(key, term, w, df): unit vectors of the terms that the vocabulary has.  The vocabulary side is left to the planner."""
    known = tf.join(vocabulary.terms, "term").crossJoin(F.broadcast(vocabulary.documents))  # one row
    raw = known.select(key, "term", "df", weight(F.col("tf"), F.col("df"), F.col("n_docs")).alias("raw"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.withColumn("norm", norm).select(key, "term", F.when(F.col("norm") > 1e-9, F.col("raw") / F.col("norm")).otherwise(F.col("raw")).alias("w"), "df")


#: Words of a batch that a worker counts at once, but for longer texts.
COUNTED = 1 << 19

#: Documents for a file of document frequencies, and the least number of files.
DOCS_A_FILE = 8000
LEAST_FILES = 16


@dataclass
class Counted:
    """The different terms of each of some texts: the rows of the batch and what they are, the terms' codes and counts."""

    rows: pa.RecordBatch
    row: np.ndarray
    code: np.ndarray
    tf: np.ndarray
    terms: pa.Array


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """(rows, row and code of each word, different words) of batches whose last column has their words, ``COUNTED`` words at once."""
    for batch in batches:
        size = np.diff(batch.columns[-1].offsets.to_numpy())
        upto = (np.cumsum(size) - size) // COUNTED
        cuts = [*np.flatnonzero(np.diff(upto, prepend=-1)), batch.num_rows]
        for first, end in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(first, end - first)
            words = part.columns[-1].flatten().dictionary_encode()
            yield part, np.repeat(np.arange(end - first), size[first:end]), words.indices.to_numpy().astype(np.int64), words.dictionary


def counted(batches: Iterator[pa.RecordBatch], stem: bool) -> Iterator[Counted]:
    """The terms of each text of these batches.  A stem is found once a task."""
    stems: dict[str, str] = {}
    for part, row, code, terms in coded(batches):
        if stem:
            words = terms.to_pylist()
            stems.update((w, porter_stem(w)) for w in words if w not in stems)
            merged = pa.array([stems[w] for w in words], pa.string()).dictionary_encode()
            code, terms = merged.indices.to_numpy().astype(np.int64)[code], merged.dictionary
        many = max(1, len(terms))
        at, tf = np.unique(row * many + code, return_counts=True)
        yield Counted(part, at // many, at % many, tf, terms)


def term_hashes(terms: pa.Array) -> np.ndarray:
    return pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False)


def file_of(h: np.ndarray, files: int) -> np.ndarray:
    """The file of hashes: ranges of equal width of their upper half."""
    return ((h >> np.uint64(32)) * np.uint64(files) >> np.uint64(32)).astype(np.int64)


def row_counts(docs: DataFrame, key: str = "urlid", text: str = "content", stopwords: tuple[str, ...] = (), stem: bool = False) -> DataFrame:
    """(key, term, tf) of each row by itself; nothing is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in counted(batches, stem):
            yield pa.RecordBatch.from_arrays([c.rows.column(0).take(pa.array(c.row)), c.terms.take(pa.array(c.code)), pa.array(c.tf)], [key, "term", "tf"])

    return docs.select(key, tokens(F.col(text), stopwords).alias("words")).mapInArrow(count, f"{typed(docs, key)}, term string, tf long")


def typed(df: DataFrame, *names: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def repeats(docs: DataFrame, key: str = "urlid") -> bool:
    """Whether documents have more than one row."""
    return not docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def stemmed_frequency(docs: DataFrame, key: str = "urlid", text: str = "content", stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(key, term, tf) over stems, counted where the texts are read, or else, if documents have several rows, by shuffles."""
    return stem_terms(term_frequency(docs, key, text, stopwords), key) if repeats(docs, key) else row_counts(docs, key, text, stopwords, True)


@dataclass(frozen=True)
class Frequencies:
    """The document frequencies of the terms of a table of documents of one row each, as sorted arrays of hashes in a folder.

    Workers look up what their texts need, so that weights are made where texts
    are read: no table of documents and terms is shuffled or written.  Terms are
    told apart by 64-bit hashes.
    """

    folder: str
    files: int
    n_docs: int
    stopwords: tuple[str, ...]
    stem: bool

    @staticmethod
    def of(docs: DataFrame, key: str = "urlid", text: str = "content", stopwords: tuple[str, ...] = (), stem: bool = False) -> Frequencies:
        folder, n = shared_path(docs.sparkSession, "frequencies"), docs.count()
        files = max(LEAST_FILES, n // DOCS_A_FILE)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = term_hashes(batch.column("term"))
                yield pa.RecordBatch.from_arrays([pa.array(file_of(h, files)), pa.array(h.view(np.int64)), batch.column("df")], ["file", "h", "df"])

        def write(part: pa.Table) -> pa.Table:
            h, df, name = part.column("h").to_numpy().view(np.uint64), part.column("df").to_numpy(), f"{folder}/{part.column('file')[0].as_py()}"
            order = np.argsort(h)
            put(f"{name}.h", h[order])
            put(f"{name}.n", df[order])
            return pa.table({"terms": [len(h)]})

        document_frequency(row_counts(docs, key, text, stopwords, stem)).mapInArrow(place, "file long, h long, df long").groupBy("file").applyInArrow(write, "terms long").agg(F.sum("terms")).first()
        return Frequencies(folder, files, n, stopwords, stem)

    def looked_up(self, h: np.ndarray) -> np.ndarray:
        """The document frequencies of different terms."""
        order, df = np.argsort(h), np.zeros(len(h), np.int64)
        at = file_of(h[order], self.files)
        edges = np.searchsorted(at, np.arange(self.files + 1))
        for k in np.flatnonzero(np.diff(edges)):
            some = order[edges[k] : edges[k + 1]]
            df[some] = mapped(f"{self.folder}/{k}.n", np.int64)[np.searchsorted(mapped(f"{self.folder}/{k}.h", np.uint64), h[some])]
        return df

    def weighed(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Counted, np.ndarray, np.ndarray, np.ndarray]]:
        """(terms of some texts, hashes of the different ones, their frequencies, unit weights of the texts' terms)."""
        for c in counted(batches, self.stem):
            h = term_hashes(c.terms)
            df = self.looked_up(h)
            raw = np.log2(c.tf + 1.0) * self.rarity(df)[c.code]
            yield c, h, df, raw / self.norms(c, raw)[c.row]

    def rarity(self, df: np.ndarray) -> np.ndarray:
        return np.log2(self.n_docs + 1.0) - np.log2(df + 1.0)

    def norms(self, c: Counted, raw: np.ndarray) -> np.ndarray:
        """What the weights of each text are divided by."""
        norm = np.sqrt(np.bincount(c.row, raw * raw, c.rows.num_rows))
        return np.where(norm > 1e-9, norm, 1.0)

    def vectors(self, docs: DataFrame, key: str = "urlid", text: str = "content", facts: tuple[str, ...] = ()) -> DataFrame:
        """(key, facts, term, w, df) as of :func:`tfidf`, with further columns of the documents."""

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c, _, df, w in self.weighed(batches):
                own = [x.take(pa.array(c.row)) for x in c.rows.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, c.terms.take(pa.array(c.code)), pa.array(w), pa.array(df[c.code])], [key, *facts, "term", "w", "df"])

        return docs.select(key, *facts, tokens(F.col(text), self.stopwords).alias("words")).mapInArrow(weigh, f"{typed(docs, key, *facts)}, term string, w double, df long")

    def packed(self, docs: DataFrame, key: str = "urlid", text: str = "content", facts: tuple[str, ...] = ()) -> DataFrame:
        """(id, t, tf, rarity, norm, facts): each document with the hashes of its terms, what their weights are made of, and further columns."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for c in counted(batches, self.stem):
                h = term_hashes(c.terms)
                rare = self.rarity(self.looked_up(h))[c.code]
                norm = self.norms(c, np.log2(c.tf + 1.0) * rare)
                ends = pa.array(np.searchsorted(c.row, np.arange(c.rows.num_rows + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (h.view(np.int64)[c.code], c.tf.astype(np.int64), rare)]
                yield pa.RecordBatch.from_arrays([*c.rows.columns[:-1], *lists, pa.array(norm)], ["id", *facts, "t", "tf", "rarity", "norm"])

        kept = docs.select(F.col(key).alias("id"), *facts, tokens(F.col(text), self.stopwords).alias("words"))
        return kept.mapInArrow(pack, f"{typed(kept, 'id', *facts)}, t array<long>, tf array<long>, rarity array<double>, norm double")


def vectors(docs: DataFrame, key: str = "urlid", text: str = "content", stopwords: tuple[str, ...] = (), stem: bool = False) -> DataFrame:
    """(key, term, w, df): unit vectors, made where the texts are read, or else, if documents have several rows, by shuffles."""
    if not repeats(docs, key):
        return Frequencies.of(docs, key, text, stopwords, stem).vectors(docs, key, text)
    tf = term_frequency(docs, key, text, stopwords)
    tf = stem_terms(tf, key) if stem else tf
    return tfidf(tf, Vocabulary.fit(tf, docs.select(key)), key)


def top_terms(tf: DataFrame, k: int = 1000) -> DataFrame:
    """The k terms of the highest total frequency, ties by term."""
    return tf.groupBy("term").agg(F.sum("tf").alias("tf")).orderBy(F.desc("tf"), "term").limit(k)


def gram_counts(docs: DataFrame, n: int, key: str = "urlid", text: str = "content") -> DataFrame:
    worded = docs.select(key, tokens(F.col(text)).alias("words"))
    return worded.select(F.explode_outer(ngrams(F.col("words"), n)).alias("gram")).where("gram is not null").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


#: Buckets that n-grams are counted in first, and how many of a batch's most frequent ones are counted by themselves then.
BUCKET_BITS = 20
LEADING = 500


def grams(words: tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, count, bucket) of each different n-gram of the texts of :func:`coded`."""
    _, row, code, terms = words
    last = max(0, len(row) - n + 1)
    start = np.flatnonzero(row[:last] == row[len(row) - last :])
    hashes, at, h = term_hashes(terms), np.zeros(len(start), np.int64), np.zeros(len(start), np.uint64)
    for k in range(n):
        at = np.unique(at, return_inverse=True)[1] * max(1, len(terms)) + code[start + k]
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[code[start + k]]
    _, first, count = np.unique(at, return_index=True, return_counts=True)
    return start[first], count, (h[first] * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def spelt(words: tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array], n: int, start: np.ndarray) -> pa.Array:
    """The n-grams at some places, words joined by a space."""
    return pc.binary_join_element_wise(*[words[3].take(pa.array(words[2][start + k])) for k in range(n)], " ")


def top_grams(docs: DataFrame, n: int, k: int = 100, text: str = "content") -> DataFrame:
    """(gram, n): the k most frequent n-grams, ties by gram.

    First all are counted in buckets by hash, of which none has less than an
    n-gram in it, and the leading ones of each batch by themselves, which count
    no more than all of them do.  So the k-th of these sums is a bound that the
    first k reach, and only n-grams of the buckets that reach it are counted in full.
    """
    worded = docs.select(tokens(F.col(text)).alias("words"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BUCKET_BITS, np.int64)
        for words in coded(batches):
            start, count, bucket = grams(words, n)
            np.add.at(total, bucket, count)
            most = np.argsort(-count, kind="stable")[:LEADING]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(most), pa.int64()), spelt(words, n, start[most]), pa.array(count[most])], ["bucket", "gram", "n"])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.nulls(len(at), pa.string()), pa.array(total[at])], ["bucket", "gram", "n"])

    sums = checkpointed(worded.mapInArrow(estimate, "bucket long, gram string, n long").groupBy("bucket", "gram").agg(F.sum("n").alias("n")))
    leading = [r["n"] for r in sums.where("gram is not null").orderBy(F.desc("n")).limit(k).select("n").collect()]
    bound = leading[-1] if len(leading) == k else 1
    kept = np.zeros(1 << BUCKET_BITS, bool)
    kept[[r["bucket"] for r in sums.where(F.col("bucket").isNotNull() & (F.col("n") >= bound)).select("bucket").collect()]] = True
    release(sums)
    bits = np.packbits(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = np.unpackbits(bits).astype(bool)
        for words in coded(batches):
            start, times, bucket = grams(words, n)
            some = open_[bucket]
            yield pa.RecordBatch.from_arrays([spelt(words, n, start[some]), pa.array(times[some])], ["gram", "n"])

    return worded.mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "gram").limit(k)


def whitelist_terms(spark: SparkSession, whitelist: list[str], stem: bool = True) -> DataFrame:
    """(term) of the listed phrases; words that don't start in lower case are not stemmed."""
    rows = spark.createDataFrame([(w, i, p) for i, w in enumerate(whitelist) for p in [w]], "phrase string, i int, p string")
    if not stem:
        return rows.select(F.col("phrase").alias("term")).distinct()
    words = rows.select("i", F.posexplode(F.split("phrase", " ")).alias("k", "word")).withColumn("word", stemmed("word"))
    return words.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "word"))).alias("ws")).select(F.array_join("ws.word", " ").alias("term")).distinct()


def whitelist_hits(docs: DataFrame, terms: DataFrame, key: str = "urlid", text: str = "content", stem: bool = True) -> DataFrame:
    """(key, term, n): listed uni-, bi- and trigrams of each document, stop words kept."""
    if stem:
        words = docs.select(key, F.posexplode(tokens(F.col(text))).alias("i", "word"))
        stems = words.select("word").distinct().withColumn("stem", stemmed("word"))
        # The stems go back into the order of the text, a document at a time.
        worded = words.join(stems, "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "stem"))).alias("ws")).select(key, F.col("ws.stem").alias("words"))
    else:
        worded = docs.select(key, tokens(F.col(text)).alias("words"))
    listed = [r["term"] for r in terms.limit(LISTED + 1).collect()]
    by_size = {n: [t for t in listed if t.count(" ") == n - 1] for n in (1, 2, 3)}
    if len(listed) > LISTED:
        grams = F.concat("words", ngrams(F.col("words"), 2), ngrams(F.col("words"), 3))
        found = worded.select(key, F.explode_outer(grams).alias("term")).where("term is not null").join(terms, "term", "left_semi")
    else:  # a short list: the grams are filtered within the row
        one_of = lambda ts: lambda t: t.isin(*ts)
        hits = [F.filter(ngrams(F.col("words"), n) if n > 1 else F.col("words"), one_of(ts)) for n, ts in by_size.items() if ts]
        found = worded.select(key, F.explode(F.concat(*hits)).alias("term")) if hits else worded.select(key, F.lit("").alias("term")).where(F.lit(False))
    return found.groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def train_vocabulary(docs: DataFrame, share: float, path: str, key: str = "urlid", text: str = "content", seed: str = "") -> tuple[DataFrame, DataFrame, Vocabulary]:
    """(training rows, rows to predict, vocabulary): a train split whose frequencies replace those at ``path``.

    The frozen vocabulary of all documents is what :meth:`Vocabulary.read` restores.
    """
    parts = docs.join(split_at(docs, share, key=key, seed=seed), key)
    train, predict = (parts.where(F.col("part") == p).drop("part") for p in ("train", "predict"))
    fitted = Vocabulary.fit(term_frequency(train, key, text), train)
    fitted.commit(path)
    return train, predict, Vocabulary.read(docs.sparkSession, path)
