"""Set-similarity self-join on word shingles with several global token orders, and its connected components.

A text's set holds the hashes of its distinct n-word shingles. Under any one order of all tokens, two sets of Jaccard
similarity t or more share a token among their first ``p = size - ceil(t * size) + 1``. The first order goes from rare to
frequent tokens, by counts over all rows: most texts have more than p tokens of their own there and need no list. Two sets can
share tokens after the ranks of a common one only, so a pair is asked for only if both ranks leave room for the common tokens
that its two sizes need. Candidates are then intersected with the prefixes under two further orders, by hashes: each pair must
share a token in every one and may not differ in more tokens of what both prefixes cover than the threshold allows; nor may
the parities of their tokens by hash differ in more places. What is left is verified on the texts themselves.

Counting moves packed arrays, not rows: tasks deal the tokens of a block of texts to ranges of hashes, those say which tokens
other rows have too, and hand them back to the block, which ranks them. Tokens that a sample shows in many rows come last in
the order and are not dealt, so that no range grows with one token; the sample decides about load only, any order is exact.

Texts of equal word sequences are one class from the start. Lists aren't expanded into pairs: a first round pairs each text
with a hub of its list, the member with the least rank, links found merge components, and only pairs of different components
are asked for after that, of which one at least is not in the largest list's hub's. So no link between components is lost, and
pairs inside one are never enumerated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored, cut, giving_back, shingles, splitmix, utf8, word_hashes

#: Lists get further hubs, for as many rounds as ROUNDS at most, while comparing the rest would take more than PAIRS a row.
ROUNDS = 3
PAIRS = 256
#: Orders by hash beside that by frequency.
ORDERS = 2
#: A block has so many tokens or texts at most (a longer text is a block of its own); a range of hashes about so many bytes of text.
BLOCK_TOKENS, BLOCK_TEXTS, RANGE_BYTES = 1 << 20, 1 << 13, 8 << 20
#: Of about so many sampled rows; tokens in HOT_ROWS of them aren't dealt, at most HOT_TOKENS.
SAMPLE, HOT_ROWS, HOT_TOKENS = 4096, 16, 1 << 20


def text_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    return np.unique(shingles(words, n))


def prefix_size(size, percent: int):
    return size - -(-percent * size // 100) + 1


def _words(texts) -> Iterator[np.ndarray]:
    """Word hashes of each text of a series or Arrow array, so many texts at a time that little of a batch is held twice."""
    for first in range(0, len(texts), 64):
        part = texts[first : first + 64]
        yield from word_hashes(utf8(part.to_pylist() if isinstance(part, pa.Array) else part))


def node_of(words: np.ndarray) -> int:
    h = xxhash.xxh3_64_intdigest(words.tobytes())
    return h - (1 << 64) if h >> 63 else h


def _keys(tokens: np.ndarray, order: int) -> np.ndarray:
    return splitmix(tokens + np.uint64(order * 0x51ED27 + 1))


def _frequent(docs: DataFrame, n: int, rows: int) -> np.ndarray:
    """Sorted keys of tokens that many rows of a sample have. Counted by key, so that no task holds the sample's texts."""

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for w in _words(batch["text"]):
                yield pd.DataFrame({"key": _keys(text_set(w, n), 0).view(np.int64)})

    sample = docs.select("text").where(F.rand(7) < SAMPLE / max(1, rows)).mapInPandas(tokens, "key long")
    often = sample.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_ROWS)
    found = often.orderBy(F.desc("c"), "key").limit(HOT_TOKENS).select("key").toPandas()
    return np.sort(found["key"].to_numpy(np.int64).view(np.uint64))


DEALT = "block long, range long, tokens binary, owners binary, counts binary, ids array<string>, sizes binary, nodes binary"


def _dealt(docs: DataFrame, n: int, ranges: int, hot: np.ndarray) -> DataFrame:
    """For each block of texts a row a range of hashes (low halves of keys, and whose they are), and one of its own, of a negative
    range, with ids, set sizes, classes and the frequent tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary()]

    def block(number: int, ids: list, sets: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets], np.uint32)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
        key = _keys(np.concatenate(sets), 0)
        frequent = np.zeros(len(key), bool)
        if len(shared.value):
            frequent = shared.value[np.minimum(np.searchsorted(shared.value, key), len(shared.value) - 1)] == key
        own = (number, -1 - number, key[frequent].tobytes(), owner[frequent].tobytes(), None, ids, sizes.tobytes(), np.array(nodes, np.int64).tobytes())
        key, owner = key[~frequent], owner[~frequent]
        place = ((key >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
        place = place.astype(np.uint16 if ranges <= 1 << 16 else np.int64)
        order = np.argsort(place, kind="stable")
        place, low, owner = place[order], key[order].astype(np.uint32), owner[order]
        starts = np.flatnonzero(np.append(True, place[1:] != place[:-1])[: len(place)])
        ends = np.append(starts, len(place))[1:]
        rows = [own, *((number, int(place[a]), low[a:z].tobytes(), owner[a:z].tobytes(), None, None, None, None) for a, z in zip(starts, ends, strict=True))]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["block", "range", "tokens", "owners", "counts", "ids", "sizes", "nodes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, 0
        ids, sets, nodes = [], [], []
        for batch in batches:
            for id_, words in zip(batch["doc_id"].to_pylist(), _words(batch["text"]), strict=True):
                tokens = text_set(words, n)
                if ids and (held + len(tokens) > BLOCK_TOKENS or len(ids) == BLOCK_TEXTS):
                    yield block(number, ids, sets, nodes)
                    number, held = number + 1, 0
                    ids, sets, nodes = [], [], []
                ids.append(id_)
                sets.append(tokens)
                nodes.append(node_of(words))
                held += len(tokens)
        if ids:
            yield block(number, ids, sets, nodes)

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(giving_back(run), DEALT)


def _repeated(part: pd.DataFrame) -> pd.DataFrame:
    """Of a range, what is in more than one row: back to each block its tokens of that kind, with their counts."""
    if part["range"].iat[0] < 0:
        return part
    blobs = part["tokens"].to_list()
    low = np.frombuffer(b"".join(blobs), np.uint32)
    owner = np.frombuffer(b"".join(part["owners"]), np.uint16)
    whose = np.repeat(np.arange(len(blobs)), [len(b) // 4 for b in blobs])
    order = (np.sort(low.astype(np.uint64) << np.uint64(32) | np.arange(len(low), dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ordered = low[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    runs = np.diff(np.append(starts, len(low)))
    count = np.empty(len(low), np.uint32)
    count[order] = np.repeat(runs, runs)
    kept = np.flatnonzero(count > 1)
    cuts = np.searchsorted(whose[kept], np.arange(len(blobs) + 1))
    rows = [(b, low[kept[a:z]].tobytes(), owner[kept[a:z]].tobytes(), count[kept[a:z]].tobytes()) for b, a, z in zip(part["block"], cuts[:-1], cuts[1:], strict=True) if a < z]
    found = pd.DataFrame(rows, columns=["block", "tokens", "owners", "counts"])
    return found.assign(range=part["range"].iat[0], ids=None, sizes=None, nodes=None)[list(part.columns)]


def _ranked(percent: int):
    """Of a block: a row a text (rank -1), and one for each token among the first p of its set that other rows have too."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own, rest = part[part["range"] < 0].iloc[0], part[part["range"] >= 0]
        sizes, nodes = np.frombuffer(own["sizes"], np.uint32).astype(np.int64), np.frombuffer(own["nodes"], np.int64)
        texts = pd.DataFrame({"doc_id": list(own["ids"]), "size": sizes, "node": pd.Series(nodes, dtype="Int64").where(sizes > 0), "token": pd.Series([None] * len(sizes), dtype="Int64"), "rank": np.int32(-1)})
        low = [np.frombuffer(b, np.uint32).astype(np.int64) for b in rest["tokens"]]
        frequent = np.frombuffer(own["tokens"], np.uint64)
        token = np.concatenate([*[x | int(r) << 32 for x, r in zip(low, rest["range"], strict=True)], -1 - (frequent >> np.uint64(1)).astype(np.int64)])
        owner = np.frombuffer(b"".join([*rest["owners"], own["owners"]]), np.uint16)
        count = np.concatenate([np.frombuffer(b"".join(rest["counts"]), np.uint32).astype(np.int64), np.full(len(frequent), 1 << 40)])
        order = np.lexsort((token, count, owner))
        token, owner = token[order], owner[order].astype(np.int64)
        here = np.bincount(owner, minlength=len(sizes))
        # tokens of one row alone come first
        rank = np.arange(len(owner)) - (np.cumsum(here) - here)[owner] + (sizes - here)[owner]
        kept = rank < prefix_size(sizes, percent)[owner]
        lists = pd.DataFrame({"doc_id": None, "size": sizes[owner[kept]], "node": pd.Series(nodes[owner[kept]], dtype="Int64"), "token": pd.Series(token[kept], dtype="Int64"), "rank": rank[kept].astype(np.int32)})
        return pd.concat([texts, lists], ignore_index=True)

    return run


def described(docs: DataFrame, n: int, percent: int) -> Stored:
    """doc_id, size (of the set) and node (a hash of the word sequence; null without words) of every row, with rank -1; and size,
    node, token and rank of the tokens among the first p of a set, rare ones first, that more than one row has."""
    kind = dict(docs.dtypes)["doc_id"]
    count, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    dealt = _dealt(docs, n, max(1, -(-size // RANGE_BYTES)), _frequent(docs, n, count))
    back = dealt.groupBy("range").applyInPandas(_repeated, DEALT)
    ranked = back.groupBy("block").applyInPandas(_ranked(percent), "doc_id string, size long, node long, token long, rank int")
    return Stored(ranked.withColumn("doc_id", F.col("doc_id").cast(kind)), release=True)


def order_keys(tokens: np.ndarray, percent: int) -> bytes:
    """The first p keys under each further order: sorted upper halves, one order after the other."""
    p = prefix_size(len(tokens), percent)
    return b"".join(np.sort(np.partition((_keys(tokens, o) >> np.uint64(32)).astype(np.uint32), p - 1)[:p]).tobytes() for o in range(1, ORDERS + 1))


def parities(tokens: np.ndarray) -> bytes:
    """For each of about twice as many places as tokens (a power of two) the parity of the tokens whose hash falls there."""
    places = 1 << max(6, (2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8), bitorder="little").tobytes()


def differences(x: bytes, y: bytes) -> int:
    """At least so many tokens are in one only of two sets with these parities."""
    a, b = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def common_tokens(total: Column, percent: int) -> Column:
    """How many tokens two sets of so many together must share: 100 * common >= percent * (total - common)."""
    return F.ceil(total * percent / (100 + percent)).cast("long")


def possible(x_size: int, y_size: int, x_keys: bytes, y_keys: bytes, x_bits: bytes, y_bits: bytes, percent: int) -> bool:
    """Whether no further order's prefixes and no parities rule a pair out."""
    apart = x_size + y_size - 2 * -(-(x_size + y_size) * percent // (100 + percent))
    if apart < 0 or differences(x_bits, y_bits) > apart:
        return False
    for a, b in zip(np.split(np.frombuffer(x_keys, np.uint32), ORDERS), np.split(np.frombuffer(y_keys, np.uint32), ORDERS), strict=True):
        shared = np.intersect1d(a, b)
        edge = min(a[-1], b[-1])
        below = int((shared < edge).sum())
        if not len(shared) or len(np.unique(a[a < edge])) + len(np.unique(b[b < edge])) - 2 * below > apart:
            return False
    return True


#: Up to this many ids of documents are sent to the tasks (8 bytes each); with more, the documents are shuffled.
SENT_IDS = 2_000_000


def _members(docs: DataFrame, listed: DataFrame, n: int, percent: int) -> Stored:
    """node, size, keys, bits and text of the classes (node, rep) that are in lists."""
    ids = listed.select(F.col("rep").alias("doc_id")).distinct()
    few = ids.count() <= SENT_IDS
    texts = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
    if not listed.where("rep is null").isEmpty():
        texts = texts.union(docs.where("doc_id is null").select("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 256):
                part, rows = batch["text"].iloc[first : first + 256], []
                for text, words in zip(part, _words(part), strict=True):
                    tokens = text_set(words, n)
                    if len(tokens):
                        rows.append((node_of(words), len(tokens), order_keys(tokens, percent), parities(tokens), text))
                yield pd.DataFrame(rows, columns=["node", "size", "keys", "bits", "text"])

    found = texts.mapInPandas(giving_back(run), "node long, size long, keys binary, bits binary, text string")
    return Stored(found.join(listed.select("node"), "node", "left_semi").dropDuplicates(["node"]), release=True)


def verified(pairs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sets are similar enough: by the further orders first, by the texts of those left then."""
    side = lambda s, *more: members.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in more])
    columns = ["size", "keys", "bits"]

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f"{s}_{c}" for c in columns for s in "ab"]
        for batch in batches:
            keep = [possible(*row, percent) for row in zip(*[batch[c] for c in names], strict=True)]
            yield batch.loc[np.array(keep, bool), ["a", "b"]]

    def similar(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for first in range(0, len(batch), 64):
                part = batch.iloc[first : first + 64]
                for i, (x, y) in enumerate(zip(_words(part["a_text"]), _words(part["b_text"]), strict=True), first):
                    s, t = text_set(x, n), text_set(y, n)
                    common = len(np.intersect1d(s, t, assume_unique=True))
                    keep[i] = 100 * common >= percent * (len(s) + len(t) - common)
            yield batch.loc[keep, ["a", "b"]]

    left = pairs.join(side("a", *columns), "a").join(side("b", *columns), "b").mapInPandas(giving_back(near), "a long, b long")
    return cut(left).join(side("a", "text"), "a").join(side("b", "text"), "b").mapInPandas(giving_back(similar), "a long, b long")


def _jump(tree: DataFrame) -> DataFrame:
    """(a, p2, p): the ancestors two and four steps up."""
    up = tree.select(F.col("a").alias("_a"), F.col("p").alias("_p"))
    once = tree.join(up, F.col("p") == F.col("_a")).select("a", F.col("_p").alias("p2"))
    return once.join(once.select(F.col("a").alias("_a"), F.col("p2").alias("_p")), F.col("p2") == F.col("_a")).select("a", "p2", F.col("_p").alias("p"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, component): the smallest id reachable over links (a, b); nodes without a link are their own.

    Alternates hooking each node to its smallest neighbour, pointer jumping and contraction, on tables in the shared
    folder: a round keeps one row a link at most, whatever the size of a component.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    edges, stars = Stored(both), None
    while not edges.df.isEmpty():
        hooked = edges.df.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("p"))
        tree = Stored(_jump(hooked))
        while not tree.df.where("p <> p2").isEmpty():
            jumped = Stored(_jump(tree.df.select("a", "p")))
            tree.drop()
            tree = jumped
        tip = tree.df.select("a", "p")
        if stars is None:
            merged = Stored(tip.select(F.col("a").alias("v"), F.col("p").alias("root")))
        else:
            merged = Stored(stars.df.join(tip, F.col("root") == F.col("a"), "left").select("v", F.coalesce("p", "root").alias("root")))
            stars.drop()
        moved = edges.df.join(tip.withColumnRenamed("p", "pa"), "a").join(tip.select(F.col("a").alias("b"), F.col("p").alias("pb")), "b")
        rest = Stored(moved.where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct())
        edges.drop()
        tree.drop()
        edges, stars = rest, merged
    edges.drop()
    if stars is None:
        return nodes.select("doc_id", F.col("doc_id").alias("component"))
    named = stars.df.select(F.col("v").alias("_v"), "root")
    return nodes.select("doc_id").join(named, F.col("doc_id") == F.col("_v"), "left").select("doc_id", F.coalesce("root", "doc_id").alias("component"))


def _room(x: str, y: str, percent: int) -> Column:
    """Whether the ranks of a token under which x and y are listed leave room for the common tokens that their sizes need."""
    need = common_tokens(F.col(f"{x}size") + F.col(f"{y}size"), percent)
    return (F.col(f"{x}size") - F.col(f"{x}rank") >= need) & (F.col(f"{y}size") - F.col(f"{y}rank") >= need)


def link_components(lists: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, component) of the nodes in lists (token, node, size, rank), over all links between them."""
    nodes = lists.select(F.col("node").alias("doc_id")).distinct()
    count, state = lists.count(), None
    for round_ in range(ROUNDS + 1):
        if state is None:
            placed = lists.withColumn("comp", F.col("node"))
        else:
            placed = lists.join(state.df.select(F.col("doc_id").alias("node"), F.col("component").alias("comp")), "node")
        # the first hub is the text that has least of its own, later ones are picked by a hash
        pick = F.struct("rank", "node", "size", "comp") if round_ == 0 else F.struct(F.xxhash64("node", "token", F.lit(round_)), "rank", "node", "size", "comp")
        of = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("size").alias("least"), F.min(pick).alias("hub"), F.min_by("comp", F.struct("rank", "node")).alias("main")).where("lo <> hi")
        smallest = F.greatest(F.col("least"), F.ceil(F.col("size") * percent / 100).cast("long"))
        fits = F.col("size") - F.col("rank") >= common_tokens(F.col("size") + smallest, percent)
        open_ = Stored(placed.join(of, "token").where(fits).select("token", "node", "size", "rank", "comp", "main", *[F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "size", "rank", "comp")]))
        if round_:
            lengths = open_.df.groupBy("token").agg(F.count("*").alias("m"), F.count_if(F.col("comp") != F.col("main")).alias("others"))
            work = lengths.agg(F.sum(F.col("m").cast("double") * F.col("others"))).first()[0] or 0
            if round_ == ROUNDS or work <= PAIRS * count:
                break
        asked = open_.df.where(F.col("comp") != F.col("hub_comp")).where(_room("", "hub_", percent))
        asked = asked.select(F.least("node", "hub_node").alias("a"), F.greatest("node", "hub_node").alias("b")).distinct()
        state = _merge(nodes, state, cut(verified(asked, members, n, percent), release=True))
        open_.drop()
    side = lambda p, f: f.select("token", *[F.col(c).alias(f"{p}{c}") for c in ("node", "size", "rank", "comp", "main")])
    x, y = side("x_", open_.df.where("comp <> main")), side("y_", open_.df)
    # both outside of the main component: once
    once = (F.col("y_comp") == F.col("y_main")) | (F.col("x_node") < F.col("y_node"))
    both = x.join(y.withColumnRenamed("token", "y_token"), (F.col("token") == F.col("y_token")) & (F.col("x_comp") != F.col("y_comp")) & once & _room("x_", "y_", percent))
    asked = both.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    state = _merge(nodes, state, cut(verified(asked, members, n, percent), release=True))
    open_.drop()
    return state.df


def _merge(nodes: DataFrame, state: Stored | None, links: DataFrame) -> Stored:
    """Components of what is known and the new links."""
    if state is not None:
        known = state.df.select(F.col("doc_id").alias("a"), F.col("component").alias("b")).where("a <> b")
        links = known.unionByName(links)
    out = Stored(components(nodes, links))
    if state is not None:
        state.drop()
    return out


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of ``100 * intersection >= percent * union``. Texts without a
    word (null, empty, white space) are linked with nothing: their component is their own id. Rows that repeat a doc_id
    are judged each by its text. Rows with a null doc_id take part in links but never name a component, unless no other does.
    Texts of any length are taken whole; an empty table gives no row. Other columns of docs are ignored. docs is read several
    times and must give the same rows in the same order (a stored table, not a sample).
    """
    docs = docs.select("doc_id", "text")
    found = described(docs, n, percent)
    rows = found.df.where("rank < 0")
    classes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    listed = found.df.where("rank >= 0").select("token", "node", "size", "rank").distinct()
    several = listed.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    lists = Stored(listed.join(several, "token"))
    asked = Stored(classes.join(lists.df.select("node").distinct(), "node"))
    members = _members(docs, asked.df, n, percent)
    linked = link_components(lists.df, members.df, n, percent)
    for done in (lists, members):
        done.drop()
    lowest = asked.df.join(linked.withColumnRenamed("doc_id", "node"), "node")
    names = lowest.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = lowest.join(names, "component").select("node", "component_id")
    alone = rows.join(label, "node", "left").join(classes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    return alone.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
