"""Full-text operators.

Searching needs no shuffle: the tokens of a document give its length and the frequency of each query
term in place, and the corpus statistics are one small aggregate.  ``postings`` is the index form.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# white space of Unicode and the marks of ASCII
SPLIT = r"[\p{IsWhite_Space}!-/:-@\[-\x60{-~]+"
K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Tokenizer:
    """Split, then lower-case, drop stop words and stem, in that order.  Marks always split."""

    lowercase: bool = True
    stemming: bool = False
    stop_words: tuple[str, ...] = field(default=())

    def column(self, text: Column) -> Column:
        out = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda t: t != "")
        if self.lowercase:
            out = F.transform(out, F.lower)
        if self.stop_words:
            out = F.filter(out, lambda t: ~t.isin(*self.stop_words))
        return F.transform(out, stem) if self.stemming else out

    def line(self, text: Column) -> Column:
        """The tokens as one string, each with a space before and after it; empty without tokens."""
        if self.stemming or self.stop_words:
            flat = F.array_join(self.column(text), "  ")
        else:
            flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPLIT, "  "))
            flat = F.lower(flat) if self.lowercase else flat
        return F.when(flat == "", flat).otherwise(F.concat(F.lit(" "), flat, F.lit(" ")))

    def words(self, text: str) -> list[str]:
        """The same for a query, in Python."""
        import regex

        out = [t for t in regex.split(r"[\p{White_Space}!-/:-@\[-\x60{-~]+", text) if t]
        out = [t.lower() for t in out] if self.lowercase else out
        out = [t for t in out if t not in self.stop_words]
        return [_stem(t) for t in out] if self.stemming else out


def stem(t: Column) -> Column:
    """One ending off: ing if over 5 bytes, else ed if over 4, else s if over 3."""
    t = F.lower(t)
    n = F.octet_length(t)
    cut = lambda k: F.substring(t, F.lit(1), F.length(t) - k)
    return F.when(t.endswith("ing") & (n > 5), cut(3)).when(t.endswith("ed") & (n > 4), cut(2)).when(t.endswith("s") & (n > 3), cut(1)).otherwise(t)


def _stem(t: str) -> str:
    t, n = t.lower(), len(t.lower().encode())
    return t[:-3] if t.endswith("ing") and n > 5 else t[:-2] if t.endswith("ed") and n > 4 else t[:-1] if t.endswith("s") and n > 3 else t


def postings(docs: DataFrame, tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text", terms: list[str] | None = None) -> DataFrame:
    """(term, id, positions, tf); only the given terms, where some are.

    A document's entries are made where it is, so nothing is shuffled unless several rows have one id.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    wanted = None if terms is None else list(dict.fromkeys(terms))

    def entries(batches):
        for batch in batches:
            lists = batch.column(1)
            for a, b in _spans(pc.list_value_length(lists).to_numpy(zero_copy_only=False)):
                part = lists.slice(a, b - a)
                n = pc.list_value_length(part).to_numpy(zero_copy_only=False)
                words = part.flatten().dictionary_encode()
                doc = np.repeat(np.arange(b - a), n)
                pos = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                if wanted is not None:
                    own = np.flatnonzero(np.isin(code, np.flatnonzero(pc.is_in(words.dictionary, pa.array(wanted, words.dictionary.type)).to_numpy(zero_copy_only=False))))
                    doc, pos, code = doc[own], pos[own], code[own]
                key = doc * max(1, len(words.dictionary)) + code
                at = np.argsort(key, kind="stable")  # positions stay in order
                starts = np.flatnonzero(np.diff(key[at], prepend=-1))
                if len(starts):
                    tf = np.diff(starts, append=len(at))
                    positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)).astype(np.int32)), pa.array(pos[at].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(code[at[starts]])), batch.column(0).slice(a, b - a).take(pa.array(doc[at[starts]])), positions, pa.array(tf.astype(np.int64))], ["term", id_col, "positions", "tf"])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(id_col, tok.column(F.col(text_col)).alias("_tokens")).mapInArrow(entries, f"term string, `{id_col}` {kind}, positions array<int>, tf bigint")
    if docs.groupBy(id_col).count().filter("count > 1").isEmpty():
        return made
    return made.groupBy("term", id_col).agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"), F.sum("tf").alias("tf"))


def _spans(sizes, limit: int = 1_000_000):
    """(from, to) of rows that have ``limit`` tokens together, or are one."""
    a = held = 0
    for b, n in enumerate(sizes):
        if held and held + n > limit:
            yield a, b
            a, held = b, 0
        held += n
    if len(sizes):
        yield a, len(sizes)


def term_stats(docs: DataFrame, terms: list[str] | None = None, tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    p = docs.select(id_col, F.explode(tok.column(F.col(text_col))).alias("term"))
    if terms is not None:
        p = p.filter(F.col("term").isin(*terms))
    per_doc = p.groupBy("term", id_col).agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total_tf"), F.avg("tf").alias("avg_positions"))


def corpus_stats(docs: DataFrame, tok: Tokenizer = Tokenizer(), text_col: str = "text") -> DataFrame:
    size = F.size(tok.column(F.col(text_col)))
    return docs.agg(F.count("*").alias("n_docs"), F.avg(size).alias("avg_len"), F.sum(size).cast("long").alias("total_len"))


def _scored(docs: DataFrame, terms: list[str], tok: Tokenizer, scorer: str, id_col: str, text_col: str, boosts: dict[str, float] | None = None, tokens: bool = False) -> DataFrame:
    """docs with _line, _dl and score (and _tokens); ``terms`` may repeat, and count as often."""
    unique = list(dict.fromkeys(terms))
    # one string per document, " a  b  a ": each token has spaces of its own, so counting is replacing
    rows = docs.select(id_col, *([tok.column(F.col(text_col)).alias("_tokens")] if tokens else []), tok.line(F.col(text_col)).alias("_line"))
    bytes_without = lambda t: F.octet_length("_line") - F.octet_length(F.replace("_line", F.lit(t)))
    count = lambda t: (bytes_without(f" {t} ") / len(f" {t} ".encode())).cast("int")
    dl = (bytes_without(" ") / 2).cast("int")
    # a generator of one row keeps filters on the counts above it: below, they would make the line anew for each count
    counts = F.struct(dl.alias("_dl"), *(count(t).alias(f"_tf{i}") for i, t in enumerate(unique)))
    rows = rows.select("*", F.explode(F.array(counts)).alias("_counts")).select(*rows.columns, "_counts.*")
    stats = rows.agg(F.count("*").cast("double").alias("_n"), F.avg("_dl").alias("_avg"), *(F.count_if(F.col(f"_tf{i}") > 0).cast("double").alias(f"_df{i}") for i in range(len(unique))))
    # the statistics are one row
    rows = rows.join(F.broadcast(stats), F.lit(True))
    parts = []
    for i, t in enumerate(unique):
        tf, df, n = F.col(f"_tf{i}").cast("double"), F.col(f"_df{i}"), F.col("_n")
        if scorer == "tf":
            s = tf
        elif scorer == "tfidf":
            s = tf * F.log(n / (1 + df))
        elif callable(scorer):
            s = scorer(tf, df, n, F.col("_dl"), F.col("_avg"))
        else:
            s = F.log((n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * F.col("_dl") / F.col("_avg")))
        weight = terms.count(t) * (boosts or {}).get(t, 1.0)
        parts.append(F.when(F.col(f"_tf{i}") > 0, s * weight).otherwise(0.0))
    return rows.withColumn("score", reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)).withColumn("_hits", reduce(lambda a, b: a + b, [(F.col(f"_tf{i}") > 0).cast("int") for i in range(len(unique))]) if parts else F.lit(0))


def _ranked(rows: DataFrame, limit: int | None, id_col: str, *more: Column) -> DataFrame:
    out = rows.select(id_col, F.round("score", 6).alias("score"), *more)
    return out if limit is None else out.orderBy(F.desc("score"), id_col).limit(limit)


def search(docs: DataFrame, query: str, limit: int | None = 10, scorer: str = "bm25", tok: Tokenizer = Tokenizer(), boosts: dict[str, float] | None = None, highlights: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with any term of the query, by summed score, then id.

    scorer: "tf", "tfidf", "bm25", or a function of the columns term count, document frequency, documents, length and
    mean length that gives a term's score.
    """
    terms = tok.words(query)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    rows = _scored(docs, terms, tok, scorer, id_col, text_col, boosts, highlights).filter("_hits > 0")
    more = []
    if highlights:
        marked = F.filter(F.transform("_tokens", lambda t, i: F.struct(t.alias("fragment"), i.alias("start"), (i + F.octet_length(t)).alias("end"))), lambda h: h["fragment"].isin(*set(terms)))
        more = [marked.alias("highlights")]
    return _ranked(rows, limit, id_col, *more)


def phrase(docs: DataFrame, query: str, limit: int | None = 10, scorer: str = "bm25", tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that hold the query's tokens one after another; a single token is a search."""
    terms = tok.words(query)
    if len(terms) < 2:
        return search(docs, query, limit, scorer, tok, id_col=id_col, text_col=text_col)
    rows = _scored(docs, terms, tok, scorer, id_col, text_col).filter(F.col("_hits") == len(set(terms)))
    return _ranked(rows.filter(F.col("_line").contains(" " + "  ".join(terms) + " ")), limit, id_col)


def boolean_and(docs: DataFrame, terms: list[str], limit: int | None = None, tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with all terms, as they are given; score 1."""
    tokens = tok.column(F.col(text_col))
    out = docs.filter(F.size(F.array_except(F.array(*(F.lit(t) for t in terms)), tokens)) == 0).select(id_col, F.lit(1.0).alias("score"))
    return out if limit is None else out.orderBy(id_col).limit(limit)


def boolean_or(docs: DataFrame, terms: list[str], limit: int | None = None, **more) -> DataFrame:
    return search(docs, " ".join(terms), limit, **more)


def boolean_not(docs: DataFrame, terms: list[str], tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with none of the terms; score 1."""
    tokens = tok.column(F.col(text_col))
    return docs.filter(~F.arrays_overlap(tokens, F.array(*(F.lit(t) for t in terms))) | (F.size(tokens) == 0)).select(id_col, F.lit(1.0).alias("score"))


def boolean(docs: DataFrame, tree: dict, tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids that satisfy a tree of {"and": [...]}, {"or": [...]}, {"not": x} over terms, in one pass."""
    tokens = tok.column(F.col(text_col))

    def holds(node) -> Column:
        if isinstance(node, str):
            return F.array_contains(tokens, node)
        (op, arg), = node.items()
        if op == "not":
            return ~holds(arg)
        return reduce(lambda a, b: a & b if op == "and" else a | b, map(holds, arg))

    return docs.filter(holds(tree)).select(id_col, F.lit(1.0).alias("score"))


# ---------------------------------------------------------------- stored postings


def build_index(docs: DataFrame, path: str, tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Postings in order of their terms, and document lengths, below ``path``.

    Files hold ranges of terms, with min, max and Bloom filters, so that a search reads the row groups of its terms alone.
    """
    p = postings(docs, tok, id_col, text_col)
    p.repartitionByRange("term", id_col).sortWithinPartitions("term", id_col).write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    docs.select(id_col, F.size(tok.column(F.col(text_col))).alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")


def search_index(spark: SparkSession, path: str, query: str, limit: int | None = 10, tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", phrase: bool = False) -> DataFrame:
    """``search`` by BM25 over stored postings; with ``phrase``, documents that hold the tokens one after another."""
    terms = tok.words(query)
    unique = list(dict.fromkeys(terms))
    if not terms:
        return spark.read.parquet(f"{path}/lengths").select(id_col, F.lit(0.0).alias("score")).limit(0)
    lengths = spark.read.parquet(f"{path}/lengths")
    hits = spark.read.parquet(f"{path}/postings").filter(F.col("term").isin(*unique))
    # a row per term of the query, and one row of statistics
    df = hits.groupBy("term").agg(F.count("*").cast("double").alias("df"))
    stats = lengths.agg(F.count("*").cast("double").alias("n"), F.avg("dl").alias("avg"))
    weight = F.create_map(*(x for t in unique for x in (F.lit(t), F.lit(float(terms.count(t))))))[F.col("term")]
    rows = hits.join(F.broadcast(df), "term").join(lengths, id_col).join(F.broadcast(stats), F.lit(True))
    tf = F.col("tf").cast("double")
    score = weight * F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * F.col("dl") / F.col("avg")))
    parts = [F.collect_list(F.when(F.col("term") == t, F.col("positions"))).alias(f"_p{i}") for i, t in enumerate(unique)] if phrase else []
    out = rows.groupBy(id_col).agg(F.sum(score).alias("score"), F.count("*").alias("_hits"), *parts)
    if phrase:
        starts = F.element_at("_p0", 1)
        follows = lambda p: reduce(lambda a, b: a & b, [F.array_contains(F.element_at(f"_p{unique.index(t)}", 1), p + k) for k, t in enumerate(terms)])
        out = out.filter(F.col("_hits") == len(unique)).filter(F.exists(starts, follows))
    return _ranked(out, limit, id_col)


def update_postings(index: DataFrame, docs: DataFrame, tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings with the documents' entries replaced, or added; a null text leaves none."""
    return delete_postings(index, docs, id_col).unionByName(postings(docs, tok, id_col, text_col))


def delete_postings(index: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return index.join(ids.select(id_col), id_col, "left_anti").select(*index.columns)


def phrase_highlights(docs: DataFrame, query: str, tok: Tokenizer = Tokenizer(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end): token places at which the phrase starts, and the place after it."""
    terms = tok.words(query)
    tokens = docs.select(id_col, tok.column(F.col(text_col)).alias("_t"))
    places = F.filter(F.sequence(F.lit(0), F.size("_t") - len(terms)), lambda i: F.slice("_t", i + 1, F.lit(len(terms))) == F.array(*map(F.lit, terms)))
    found = tokens.filter(F.size("_t") >= len(terms)).select(id_col, F.explode(places).alias("start"))
    return found.select(id_col, "start", (F.col("start") + len(terms)).alias("end"))
