"""Records that meet, exactly or almost, in several splits.

Method: weighted cosine join between the splits. A text is a vector of numbered word bigrams (the second ``a b`` of a
text is another term than its first); a term's weight is the root of its inverse document frequency, so that the dot
product of two texts is the sum of the frequencies' logarithms over what they share, repeats included.
* Counts come from all texts over 65,536 hash buckets (a table of fixed size). A term's greatest weight in any text is
  the same everywhere, and terms are taken in falling order of it.
* ``d`` words changed, added or dropped cost a text at most its 2d heaviest terms. What is left is the dot product that
  the text needs with any partner within one word in eight; with its norm this is a cosine of its own for each text.
* Inverted lists hold, of each text, only the first terms: the rest alone, with the greatest weights that they can
  meet, stays below the dot product needed (maximum-weight pruning).
* Where two lists meet, the terms not before the place can share no more than the smaller residual norm squared of the
  two texts; pairs that cannot reach what both need are dropped there (residual-norm pruning), like pairs whose 128-bit
  sketches of word parities differ in more bits than d words can change.
* What is left gets its exact dot product and cosine and, last, as the bound is stated in words, the exact count of
  changed words.
Nothing is lost by the pruning, at any size; there is no cap on partners. Long lists are split: the train side of a
term by a salt, the other side repeated for each, so that no task holds more than about LIST train entries of a term.

Copies (texts that are the same when case, width, punctuation, spacing, emoji, emoticons, links and tags are
disregarded) form one class; a class has a vector for each way its words are spaced. A text that fills a third of all
rows is one vector. Rows come back through the membership of classes; ``classes`` gives the pairs of classes with their
numbers of rows, which does not grow with the product of copies.

Defined cases: rows without id, split or a post text of 20 letters and digits give nothing; splits other than train,
val and test give nothing; repeated rows count once; an id that stands in both splits is no pair with itself.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from graftline.runtime import Scratch, spread

LEAST, SHARE, K, BUCKETS = 20, 8, 2, 1 << 16
#: Train entries of one term that a task takes at most.
LIST = 20_000
_LINKS = regex.compile(r"(?:https?://|www\.)[!-~]+")
_TAGS = regex.compile(r"#(?=\S)[^#\n]{1,40}(?<=\S)#|#[\p{L}\p{M}\p{N}_]+")
_FACES = regex.compile(r"\[\p{L}{1,8}\]|[(][^()\p{Han}\p{Cyrillic}A-Za-z0-9]{1,16}[)]|(?<![\p{L}\p{N}])(?:[:;=8xX]['^o-]?[()DPp3/\\|*]|[TtQq][_.][TtQq]|[oO0>^][_.-]+[oO0<^]|orz|OTZ|QAQ|qaq|XD|xD|<3)(?![\p{L}\p{N}])")
_APOSTROPHES = regex.compile(r"(?<=\p{L})['’‘ʼ`´](?=\p{L})")
_WORDS = regex.compile(r"\p{Han}|(?:(?!\p{Han})[\p{L}\p{M}\p{N}])+")


def words(text: str | None) -> list[str]:
    """Words of a text without what is to be disregarded; a Chinese character is a word."""
    if not text:
        return []
    text = unicodedata.normalize("NFKC", text)
    text = _FACES.sub(" ", _TAGS.sub(" ", _LINKS.sub(" ", text)))
    return _WORDS.findall(_APOSTROPHES.sub("", text).casefold())


def posts(rows: DataFrame) -> DataFrame:
    """(id, split_name, source, post): the text between the line ``content:`` and the line starting ``userinterest:``."""
    user = F.get(F.filter("messages", lambda m: m.role == "user"), 0).content
    post = F.regexp_extract(user, r"(?s)(?:^|\n)content:[ \t\r]*\n(.*?)\n?userinterest:", 1)
    return rows.where("id IS NOT NULL AND split_name IN ('train', 'val', 'test')").select("id", "split_name", "source", post.alias("post")).where("post <> ''")


def keyed(rows: DataFrame) -> DataFrame:
    """(id, split_name, source, text_class, words) of the rows that count; words joined by spaces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: dict[str, tuple[bytes, str] | None] = {}
            out = []
            for row in zip(batch["id"], batch["split_name"], batch["source"], batch["post"]):
                if row[3] not in seen:
                    w = words(row[3])
                    whole = "".join(w)
                    seen[row[3]] = (hashlib.blake2b(whole.encode(), digest_size=16).digest(), " ".join(w)) if len(whole) >= LEAST else None
                if seen[row[3]]:
                    out.append((*row[:3], *seen[row[3]]))
            yield pd.DataFrame(out, columns=["id", "split_name", "source", "text_class", "words"])

    return spread(posts(rows)).mapInPandas(run, "id string, split_name string, source string, text_class binary, words string")


def terms(w: list[str]) -> list[int]:
    """Hashes of the numbered word bigrams."""
    seen: Counter = Counter()
    out = []
    for a, b in zip(w, w[1:]):
        pair = f"{a} {b}"
        seen[pair] += 1
        out.append(xxhash.xxh3_64_intdigest(f"{pair} {seen[pair]}"))
    return out


def sketch(w: list[str]) -> tuple[int, int]:
    """Parities of the words' counts in 128 hash cells; one word changed flips two at most."""
    bits = 0
    for x in w:
        bits ^= 1 << (xxhash.xxh3_64_intdigest(x) & 127)
    return (bits & (2**64 - 1)) - 2**63, (bits >> 64) - 2**63


def _vectors(reps: DataFrame) -> DataFrame:
    """reps with their terms, words counted and sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            split = [text.split(" ") for text in batch["words"]]
            sketches = [sketch(w) for w in split]
            yield batch.assign(
                terms=[np.array(terms(w), dtype=np.uint64).view(np.int64) for w in split], n_words=[len(w) for w in split], s1=[s for s, _ in sketches], s2=[s for _, s in sketches])

    fields = "text_class binary, words string, train boolean, eval boolean, terms array<bigint>, n_words int, s1 bigint, s2 bigint"
    return reps.select("text_class", "words", "train", "eval").mapInPandas(run, fields)


def frequencies(vectors: DataFrame) -> np.ndarray:
    """Inverse document frequency of each of BUCKETS hash buckets, from the terms of all texts; a table of fixed size."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    bucket = F.col("term").bitwiseAND(F.lit(BUCKETS - 1))
    for row in vectors.select(F.explode("terms").alias("term")).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect():  # at most BUCKETS rows
        total[row.bucket] = row.n
    return np.log1p(total.sum() / np.maximum(total, 1))


def squares(t: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Squared weights of terms."""
    return idf[t & (BUCKETS - 1)]


def _postings(vectors: DataFrame, idf: Broadcast) -> DataFrame:
    """Inverted lists: (term, text_class, n_words, need, residual, s1, s2, train, eval); need is the least dot product with
    a partner, residual the squared norm of the term and those after it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for cls, t, n, s1, s2, train, other in zip(*(batch[c] for c in ("text_class", "terms", "n_words", "s1", "s2", "train", "eval"))):
                most = n // (SHARE - 1)  # no partner of this text may differ in more words
                if not most:
                    continue
                w = squares(t, idf.value)
                order = np.lexsort((t, -w))
                w = w[order]
                residual = w[::-1].cumsum()[::-1]
                need = residual[K * most] if K * most < len(w) else 0.0
                out += [(x, cls, n, need, r, s1, s2, train, other) for x, r in zip(t[order[: K * most + 1]].tolist(), residual)]
            yield pd.DataFrame(out, columns=["term", "text_class", "n_words", "need", "residual", "s1", "s2", "train", "eval"])

    fields = "term bigint, text_class binary, n_words int, need double, residual double, s1 bigint, s2 bigint, train boolean, eval boolean"
    return vectors.select("text_class", "terms", "n_words", "s1", "s2", "train", "eval").mapInPandas(run, fields)


def _candidates(postings: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b): classes of train and of val or test that pruning leaves; hot(term, salts) are the terms with long lists."""
    salts = F.coalesce("salts", F.lit(1))
    x = postings.where("train").drop("train", "eval").join(hot, "term", "left").withColumn("salt", F.pmod(F.xxhash64("text_class"), salts)).drop("salts")
    y = postings.where("eval").select("term", *[F.col(c).alias(f"o_{c}") for c in ("text_class", "n_words", "need", "residual", "s1", "s2")])
    y = y.join(hot, "term", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), salts - 1))).drop("salts")
    changed = F.floor(F.greatest("n_words", "o_n_words") / SHARE)
    bits = F.bit_count(F.col("s1").bitwiseXOR(F.col("o_s1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("o_s2")))
    reach = F.least("residual", "o_residual") * (1 + 1e-9) >= F.greatest("need", "o_need")
    near = (F.abs(F.col("n_words") - F.col("o_n_words")) <= changed) & (bits <= 2 * changed)
    met = x.join(y, ["term", "salt"]).where((F.col("text_class") != F.col("o_text_class")) & reach & near)
    return met.select(F.col("text_class").alias("a"), F.col("o_text_class").alias("b")).distinct()


def changed_words(a: list[str], b: list[str], most: int) -> int:
    """Words changed, added or dropped between a and b, or most + 1 where there are more; a band of the table suffices."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[: len(a) - j], b[: len(b) - j]
    far = most + 1
    row = [x if x <= most else far for x in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        low, high = max(1, i - most), min(len(b), i + most)
        new = [far] * (len(b) + 1)
        new[0] = i if i <= most else far
        for j in range(low, high + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
    return min(row[len(b)], far)


_NEAR = T.StructType([T.StructField("near", T.BooleanType()), T.StructField("dot", T.DoubleType()), T.StructField("cosine", T.DoubleType())])


def _measured(a: Column, b: Column, idf: Broadcast) -> Column:
    """Struct of whether two word sequences are within one word in eight, their dot product and cosine."""

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(left, right):
            v, w = x.split(" "), y.split(" ")
            most = max(len(v), len(w)) // SHARE
            t, u = (np.array(terms(z), dtype=np.uint64).view(np.int64) for z in (v, w))
            shared = np.intersect1d(t, u)  # terms are numbered, so each occurs once
            dot = float(squares(shared, idf.value).sum())
            norms = float(squares(t, idf.value).sum() * squares(u, idf.value).sum()) ** 0.5
            near = len(shared) >= max(len(v), len(w)) - 1 - K * most and changed_words(v, w, most) <= most
            out.append((near, dot, dot / norms if norms else 0.0))
        return pd.DataFrame(out, columns=["near", "dot", "cosine"])

    run.__annotations__ = {"left": pd.Series, "right": pd.Series, "return": pd.DataFrame}
    return pandas_udf(run, _NEAR)(a, b)


class Overlaps:
    """Classes of copies, pairs of near classes, and the rows' membership."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        scratch = Scratch(spark, "overlap")
        self.members = scratch.write(keyed(rows))
        train = F.col("split_name") == "train"
        self.reps = self.members.groupBy("text_class", "words").agg(F.bool_or(train).alias("train"), F.bool_or(~train).alias("eval"))
        vectors = scratch.write(_vectors(self.reps))
        idf = spark.sparkContext.broadcast(frequencies(vectors))
        postings = scratch.write(_postings(vectors, idf))
        hot = scratch.write(postings.groupBy("term").agg(F.count_if("train").alias("n"), F.bool_or("eval").alias("met")).where(f"met AND n > {LIST}").select("term", F.ceil(F.col("n") / LIST).alias("salts")))
        text = lambda k: vectors.select(F.col("text_class").alias(k), F.col("words").alias(f"words_{k}"))
        both = _candidates(postings, hot).join(text("a"), "a").join(text("b"), "b")
        near = both.select("a", "b", _measured(F.col("words_a"), F.col("words_b"), idf).alias("m")).where("m.near").groupBy("a", "b").agg(F.max("m.dot").alias("dot"), F.max("m.cosine").alias("cosine"))
        own = self.members.groupBy("text_class").agg(F.bool_or(train).alias("train"), F.bool_or(~train).alias("eval")).where("train AND eval")
        same = own.select(F.col("text_class").alias("a"), F.col("text_class").alias("b"), F.lit(None).cast("double").alias("dot"), F.lit(1.0).alias("cosine"))
        self.pairs = scratch.write(near.unionByName(same))

    def found(self) -> DataFrame:
        """(id_a, id_b): every pair of a row of train and one of val or test."""
        ids = self.members.select("id", "text_class", (F.col("split_name") == "train").alias("train")).distinct()
        x = ids.where("train").select(F.col("id").alias("x"), F.col("text_class").alias("a"))
        y = ids.where("NOT train").select(F.col("id").alias("y"), F.col("text_class").alias("b"))
        both = self.pairs.select("a", "b").join(x, "a").join(y, "b").where("x <> y")
        return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def classes(self) -> DataFrame:
        """(train_class, eval_class, cosine, dot, n_train, n_eval): pairs of classes with the rows that each has."""
        ids = self.members.select("id", "text_class", (F.col("split_name") == "train").alias("train")).distinct()
        n = ids.groupBy("text_class").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_eval"))
        a, b = n.select(F.col("text_class").alias("a"), "n_train"), n.select(F.col("text_class").alias("b"), "n_eval")
        return self.pairs.join(a, "a").join(b, "b").select(F.hex("a").alias("train_class"), F.hex("b").alias("eval_class"), "cosine", "dot", "n_train", "n_eval")

    def membership(self) -> DataFrame:
        """(id, split_name, text_class): the class of each distinct row."""
        return self.members.select("id", "split_name", F.hex("text_class").alias("text_class")).distinct()

    def report(self) -> DataFrame:
        """Per split and source of the val or test row: rows with an overlap and pairs, counted without making the pairs."""
        each = self.members.select("id", "split_name", "source", "text_class").distinct()
        n_train = each.where("split_name = 'train'").groupBy(F.col("text_class").alias("a")).agg(F.count_distinct("id").alias("n"))
        met = self.pairs.select("a", "b").join(n_train, "a").groupBy(F.col("b").alias("text_class")).agg(F.sum("n").alias("n"))
        hit = each.where("split_name <> 'train'").join(met, "text_class")
        return hit.groupBy("split_name", "source").agg(F.count_distinct("id").alias("n_rows"), F.sum("n").alias("n_pairs"))
