"""Features, forests and embeddings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.checkpoints import checkpointed, stored
from . import word_vectors
from .order_stats import percentiles, values_at_ranks

#: The parts of a feature vector.
CATEGORICAL = ("event_type", "host", "user", "process", "action", "status", "protocol")
NUMERIC = ("pid", "parent_pid", "src_port", "dst_port", "bytes_sent", "bytes_recv")
TEXT = ("command_line", "message", "file_path")
CATEGORY_BUCKETS, TEXT_BUCKETS = 64, 32
DIM = len(CATEGORICAL) * CATEGORY_BUCKETS + 2 * len(NUMERIC) + TEXT_BUCKETS


def numeric_ranges(events: DataFrame) -> DataFrame:
    """One row: the least and the greatest of each numeric field that is there."""
    have = [c for c in NUMERIC if c in events.columns]
    return events.agg(*(f(F.col(c).cast("double")).alias(f"{c}_{n}") for c in have for f, n in ((F.min, "lo"), (F.max, "hi"))))


def event_features(events: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(event_id, features): array of structs (index, value), sparse: hashed categories, scaled numbers and a token bag of length 1."""
    ranges = numeric_ranges(events) if ranges is None else ranges
    have = set(events.columns)
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    item = lambda i, v: F.struct(i.alias("index"), v.alias("value"))
    parts = []
    for n, c in enumerate(CATEGORICAL):
        if c in have:
            parts.append(F.when(F.col(c) != "", item(bucket(F.col(c).cast("string"), CATEGORY_BUCKETS) + n * CATEGORY_BUCKETS, F.lit(1.0))))
    base = len(CATEGORICAL) * CATEGORY_BUCKETS
    for n, c in enumerate(NUMERIC):
        if c in have:
            x = F.col(c).cast("double")
            span = F.greatest(F.lit(1.0), F.col(f"{c}_hi") - F.col(f"{c}_lo"))
            parts.append(F.when(x.isNotNull(), item(F.lit(base + 2 * n), (x - F.col(f"{c}_lo")) / span)))
            parts.append(F.when(x.isNotNull(), item(F.lit(base + 2 * n + 1), F.log1p(F.abs(x)))))
    text = F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in TEXT if c in have))
    tokens = F.array_remove(F.split(F.lower(text), r"\s+"), "")
    hashed = F.transform(tokens, lambda t: F.pmod(F.xxhash64(t), F.lit(TEXT_BUCKETS)).cast("int"))

    def bag(h: Column) -> Column:
        counts = F.transform(F.array_sort(F.array_distinct(h)), lambda b: F.struct(b.alias("b"), (F.size(h) - F.size(F.array_remove(h, b))).cast("double").alias("n")))

        def scaled(c: Column) -> Column:
            norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x["n"] * x["n"]))
            return F.transform(c, lambda x: F.struct((x["b"] + base + 2 * len(NUMERIC)).alias("index"), (x["n"] / norm).alias("value")))

        return F.transform(F.array(counts), scaled)[0]

    features = F.concat(F.array_compact(F.array(*parts)), F.transform(F.array(hashed), bag)[0])
    return events.join(F.broadcast(ranges)).select("event_id", features.alias("features"))


def dense_numeric(events: DataFrame, columns: list[str]) -> DataFrame:
    """(event_id, x): the columns as one array of doubles, null as 0."""
    return events.select("event_id", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).alias("x"))


def fit_isolation_forest(rows: DataFrame, trees: int = 64, sample: int = 256, seed: int = 42) -> DataFrame:
    """(tree, node, feature, threshold, left, right, size, depth): a forest as a table of at most trees * 2 * sample rows.

    rows: (event_id, x).  A tree's sample are the rows whose seeded hash with the
    tree's number is least; each task keeps so many of each tree at most,
    before anything is shuffled.  A tree is built in a group of ``sample`` rows.
    """
    n = rows.count()
    share = min(1.0, 4.0 * sample / max(1, n))
    keyed = rows.select("event_id", "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")) if n <= sample else _sampled(rows, trees, share, seed)
    keyed = keyed.withColumn("h", F.xxhash64("event_id", F.col("tree") + seed))
    first = F.row_number().over(Window.partitionBy("tree").orderBy("h", "event_id"))
    chosen = keyed.withColumn("n", first).where(F.col("n") <= sample).select("tree", "x", "n")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import math

        import numpy as np

        x = np.stack(pdf.sort_values("n")["x"].to_numpy())
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        limit = math.ceil(math.log2(max(2, len(x))))
        out: list[list] = []
        todo = [(0, np.arange(len(x)), 0)]
        out.append([tree, 0, -1, 0.0, -1, -1, len(x), 0])
        while todo:
            node, at, depth = todo.pop()
            if len(at) <= 1 or depth >= limit:
                continue
            spread = np.flatnonzero(x[at].max(axis=0) > x[at].min(axis=0))
            if not len(spread):
                continue
            feature = int(rng.choice(spread))
            column = x[at, feature]
            threshold = float(rng.uniform(column.min(), column.max()))
            sides = at[column < threshold], at[column >= threshold]
            if not len(sides[0]) or not len(sides[1]):
                continue
            out[node][2:6] = [feature, threshold, len(out), len(out) + 1]
            for side in sides:
                out.append([tree, len(out), -1, 0.0, -1, -1, len(side), depth + 1])
                todo.append((len(out) - 1, side, depth + 1))
        return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])

    return chosen.groupBy("tree").applyInPandas(build, "tree int, node int, feature int, threshold double, left int, right int, size int, depth int")


def _sampled(rows: DataFrame, trees: int, share: float, seed: int) -> DataFrame:
    """(event_id, x, tree): for each tree the rows whose hash falls into the share, about four samples' worth."""
    part = 1 << 30
    picks = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(F.xxhash64("event_id", t + seed + 1000), F.lit(part)) < int(share * part))
    return rows.select("event_id", "x", F.explode(picks).alias("tree"))


def score_isolation_forest(rows: DataFrame, forest: DataFrame) -> DataFrame:
    """(event_id, score): 2 ** (-mean path / c(sample)); the forest is broadcast, its size is bounded by its parameters."""
    table = forest.toPandas().sort_values(["tree", "node"])
    shared = rows.sparkSession.sparkContext.broadcast({k: g.reset_index(drop=True) for k, g in table.groupby("tree")})

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        def c(n):
            n = np.maximum(np.asarray(n, float), 1.0)
            h = np.where(n > 1, np.log(np.maximum(n - 1, 1)) + 0.5772156649, 0.0)
            return np.where(n > 1, 2 * h - 2 * (n - 1) / n, 0.0)

        for batch in batches:
            if not len(batch):
                continue
            x, total, norm = np.stack(batch["x"].to_numpy()), np.zeros(len(batch)), 1.0
            for t in shared.value.values():
                f, th, left, right, size, depth = (t[k].to_numpy() for k in ("feature", "threshold", "left", "right", "size", "depth"))
                at = np.zeros(len(x), np.int64)
                while (inner := f[at] >= 0).any():
                    go = np.flatnonzero(inner)
                    smaller = x[go, f[at[go]]] < th[at[go]]
                    at[go] = np.where(smaller, left[at[go]], right[at[go]])
                total += depth[at] + c(size[at])
                norm = float(c(size[0])) or 1.0
            yield pd.DataFrame({"event_id": batch["event_id"], "score": 2.0 ** (-total / max(1, len(shared.value)) / norm)})

    return rows.mapInPandas(score, "event_id long, score double")


def flag_anomalies(scores: DataFrame, contamination: float = 0.05) -> DataFrame:
    """(event_id, score, threshold, anomaly): the rows that score at least as high as the row at 1 - contamination of all, in order."""
    scores = checkpointed(scores)
    n = scores.agg(F.count("*").alias("n"))
    # the place as an integer part of rows, as the forest is fitted
    rank = n.select(F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(1 - contamination)))).alias("rank"))
    threshold = values_at_ranks(scores, [], "score", rank).select(F.col("value").alias("threshold"))
    return scores.crossJoin(F.broadcast(threshold)).withColumn("anomaly", F.col("score") >= F.col("threshold"))


def build_vocab(texts: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """(word, id, count): the n - 2 most frequent lower-cased words, ids from 2, ties to the lesser word."""
    words = texts.select(F.explode(F.array_remove(F.split(F.lower(F.col(text_col)), r"\s+"), "")).alias("word"))
    top = words.groupBy("word").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "word").limit(max(0, n - 2))
    return top.withColumn("id", F.row_number().over(Window.orderBy(F.desc("count"), "word")) + 1).select("word", "id", "count")


def encode_tokens(texts: DataFrame, vocab: DataFrame, max_len: int, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, ids): the first max_len words' ids, 1 for unknown words, 0 to fill up."""
    words = F.slice(F.array_remove(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"\s+"), ""), 1, max_len)
    placed = texts.select(id_col, F.posexplode(words).alias("p", "word")).join(vocab.select("word", "id"), "word", "left")
    found = placed.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", F.coalesce("id", F.lit(1)).alias("t")))), lambda x: x["t"]).alias("ids"))
    none = F.array().cast("array<int>")
    return texts.select(id_col).join(found, id_col, "left").withColumn("ids", F.slice(F.concat(F.coalesce("ids", none), F.array_repeat(F.lit(0), max_len)), 1, max_len))


def pool_embeddings(vectors: Column, mask: Column, how: str = "mean", normalize: bool = False) -> Column:
    """One vector from an array of token vectors and a 0/1 mask: cls takes the first, mean and max the masked ones."""
    live = F.filter(F.zip_with(vectors, mask, lambda v, m: F.struct(v.alias("v"), m.alias("m"))), lambda x: x["m"] == 1)
    live = F.transform(live, lambda x: x["v"])
    zero = F.transform(vectors[0], lambda x: F.lit(0.0))
    if how == "cls":
        out = F.transform(vectors[0], lambda x: x.cast("double"))
    elif how == "mean":
        total = F.aggregate(live, zero, lambda a, v: F.zip_with(a, v, lambda p, q: p + q.cast("double")))
        out = F.transform(total, lambda x: x / F.greatest(F.size(live).cast("double"), F.lit(1e-9)))
    elif how == "max":
        least = F.transform(vectors[0], lambda x: F.lit(-1e9))
        out = F.aggregate(live, least, lambda a, v: F.zip_with(a, v, lambda p, q: F.greatest(p, q.cast("double"))))
    else:
        raise ValueError(how)
    if not normalize:
        return out
    return F.transform(F.array(out), lambda v: F.transform(v, lambda x: x / F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, y: s + y * y)), F.lit(1e-12))))[0]


def average_parameters(parameters: DataFrame) -> DataFrame:
    """(category, name, position, value): the mean of each element over the clients that have it."""
    rows = parameters.select("category", "name", F.posexplode("values").alias("position", "v"))
    return rows.groupBy("category", "name", "position").agg(F.avg("v").alias("value"))


def _mean_vectors(rows: DataFrame, key: str, x: Column, name: str) -> DataFrame:
    """(key, name): the mean of arrays by key, as whole vectors that are summed in each task first."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = rows.select(key, array_to_vector(x).alias("v"))
    return rows.groupBy(key).agg(Summarizer.mean(F.col("v")).alias("m")).select(key, vector_to_array("m").alias(name))


def neighbor_means(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, x, mean): a node's vector and the mean of its neighbours', zeros without any; an edge moves one vector."""
    ends = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    mean = _mean_vectors(ends.join(nodes.select(F.col("node").alias("b"), "x"), "b"), "a", F.col("x"), "mean").withColumnRenamed("a", "node")
    return nodes.join(mean, "node", "left").withColumn("mean", F.coalesce("mean", F.transform("x", lambda v: F.lit(0.0))))


def neighbor_features(nodes: DataFrame, edges: DataFrame, layers: int = 2) -> DataFrame:
    """``nodes`` with x made longer by each layer: a node's vector and the mean of its neighbours', which after two layers tells of nodes two edges away."""
    edges = checkpointed(edges.select("src", "dst"))
    for _ in range(layers):
        nodes = checkpointed(neighbor_means(nodes, edges).withColumn("x", F.concat("x", "mean")).drop("mean"))
    return nodes


def fit_token_embeddings(docs: DataFrame, tokens_col: str = "tokens", size: int = 30, window: int = 5, min_count: int = 1, seed: int = 42, partitions: int | None = None, negatives: int = 5, rate: float = 0.15) -> DataFrame:
    """(word, vector): word2vec (skip-grams, ``negatives`` random words to a pair) over arrays of tokens, one pass in ``partitions`` parts (one for each 2,000,000 tokens unless given).

    A part knows its own words only, all of which start where their hashes say; a
    word's vector is the mean of its parts', by its number of times in each.
    """
    if min_count > 1:
        docs = _without_rare(docs, tokens_col, min_count)
    if partitions is None:
        partitions = max(1, math.ceil((docs.agg(F.sum(F.size(tokens_col))).first()[0] or 0) / word_vectors.PART))
    # dealt in turns, as documents may be alike; then in an order that their words alone decide
    dealt = word_vectors.pieces(docs, tokens_col, window).repartition(partitions).sortWithinPartitions(F.xxhash64("tokens", "lead"))
    parts = word_vectors.trained_parts(dealt, size, window, negatives, rate, seed)
    mean = F.array(*(F.sum(F.get("v", F.lit(i)) * F.col("times")) / F.sum("times") for i in range(size)))
    # a word is in a part once: nothing to add up before the shuffle
    return stored(parts.repartition("word").groupBy("word").agg(mean.alias("vector")))


def _without_rare(docs: DataFrame, tokens_col: str, min_count: int) -> DataFrame:
    """Documents as (``tokens_col``) without the words that are in fewer than ``min_count`` places."""
    rows = stored(docs.select(tokens_col, F.monotonically_increasing_id().alias("doc")).select("doc", F.posexplode(tokens_col).alias("at", "word")))
    known = rows.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    kept = rows.join(known, "word", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    return kept.select(F.col("w.word").alias(tokens_col))


def embed_documents(docs: DataFrame, vectors: DataFrame, size: int, id_col: str = "node", tokens_col: str = "tokens", positional: bool = True) -> DataFrame:
    """(id, x): the mean over known words of their vector and, if asked for, the sine and cosine of their place among known words.

    Places are 0, 1, .. whatever the words are, so their waves are a sum that the
    number of known words gives; the words themselves count once for each
    document with their number of times.  A document without a known word gets zeros.
    """
    times = docs.select(id_col, F.explode(tokens_col).alias("word")).groupBy(id_col, "word").agg(F.count("*").cast("double").alias("times"))
    # plain sums: a task adds them up without an object for each row
    sums = times.join(vectors, "word").groupBy(id_col).agg(F.sum("times").alias("n"), *(F.sum(F.get("vector", F.lit(i)) * F.col("times")).alias(f"s{i}") for i in range(size)))
    waves = [_wave_sum(F.col("n"), i, size) if positional else F.lit(0.0) for i in range(size)]
    sums = sums.select(id_col, F.array(*((F.col(f"s{i}") + wave) / F.col("n") for i, wave in enumerate(waves))).alias("x"))
    return docs.select(id_col).join(sums, id_col, "left").withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), size)))


def _wave_sum(n: Column, i: int, size: int) -> Column:
    """The sum over places 0 to n - 1 of the sine (even i) or cosine (odd i) of the place times i's frequency."""
    half = 10000.0 ** (-(i - i % 2) / size) / 2
    middle = (n - 1) * half
    return F.sin(n * half) / math.sin(half) * (F.sin(middle) if i % 2 == 0 else F.cos(middle))


def reconstruction_error(rows: DataFrame, bottleneck: int = 2) -> DataFrame:
    """(event_id, error, score): squared error behind a linear bottleneck (principal components of scaled columns).

    The score is 0 at the 95th percentile of the errors and 1 at the 99th, both exact.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vectors = rows.select("event_id", array_to_vector("x").alias("v"))
    scaler = StandardScaler(inputCol="v", outputCol="z", withMean=True, withStd=True).fit(vectors)
    scaled = scaler.transform(vectors)
    model = PCA(k=bottleneck, inputCol="z", outputCol="c").fit(scaled)
    basis = model.pc.toArray().tolist()
    flat = model.transform(scaled).select("event_id", vector_to_array("z").alias("z"), vector_to_array("c").alias("c"))
    matrix = F.array(*(F.array(*map(F.lit, row)) for row in basis))
    back = F.transform(matrix, lambda row: F.aggregate(F.zip_with(row, F.col("c"), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))
    error = F.aggregate(F.zip_with("z", back, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size("z")
    errors = flat.select("event_id", error.alias("error"))
    errors = checkpointed(errors)
    cuts = percentiles(errors, [], "error", [0.95, 0.99])
    low, high = F.col("p")[0], F.col("p")[1]
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("error") - low) / F.greatest(high - low, F.lit(1e-12))))
    return errors.join(F.broadcast(cuts)).select("event_id", "error", score.alias("score"))


def save_model(model: DataFrame, path: str, version: str, **metadata: str) -> None:
    """A model that is a table (such as a forest), under its version; metadata in a row beside it."""
    model.write.mode("overwrite").parquet(f"{path}/version={version}/model")
    row = model.sparkSession.createDataFrame([(version, {k: str(v) for k, v in metadata.items()})], "version string, metadata map<string,string>")
    row.coalesce(1).write.mode("overwrite").json(f"{path}/version={version}/metadata")


def load_model(spark: SparkSession, path: str, version: str) -> tuple[DataFrame, dict[str, str]]:
    """(model, metadata) as ``save_model`` wrote them."""
    row = spark.read.schema("version string, metadata map<string,string>").json(f"{path}/version={version}/metadata").first()
    return spark.read.parquet(f"{path}/version={version}/model"), dict(row["metadata"])
