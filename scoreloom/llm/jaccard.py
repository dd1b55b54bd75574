"""Similarity join of texts by the Jaccard coefficient of their sets of word n-grams, with token-combination prefixes.

Every text becomes the set of hashes of its distinct runs of `width` words (see blocks.py for words; a shorter text
is one run). Texts with equal sets form one node. Two nodes link when DEN * |x & y| >= NUM * |x | y|.

Tokens are ordered: rare ones by hash, then frequent ones by hash. Of a set of s tokens a partner may miss at most
e = s - ceil(NUM * s / DEN). Its prefix takes tokens in this order until what is left of them after any e are missing still
makes a signature. A rare token is a signature by itself. Frequent tokens are dealt into classes by hash, and every
pair of prefix tokens of one class is a signature, so a class with n of them survives n - 2 losses; the prefix is
extended accordingly. The number of classes follows the size of the set in bands; a set gives the signatures of its own
band and of the next one, since a partner lies in the same or the neighbouring band. Linked nodes share a signature
whatever tokens are called frequent; that choice only decides how many other pairs share one. Frequent are tokens
that blocks of texts repeat, counted over all blocks; the most common FREQUENT_MOST of them are sent to all tasks.

Signatures that up to SMALL nodes share give all their pairs. Those of more nodes give first a star around the node with
the fewest rare tokens (the most tokens of these), later the pairs that lie in different components by then. Pairs go through exact bounds: sizes;
rare tokens of the prefix that ends first and are not in the other; rare tokens that cannot be shared; for the later pairs also
the bits in which the sets' sketches differ, which are at most the tokens that only one of the sets has. What remains is
compared set by set.

Cases. Null and empty texts, texts without words: no tokens, component of their own, linked with nothing. Null ids: null
component. Repeated rows: each gets its row; rows of one id and different texts link what each of them links.
Very long texts: whole. Ties: the least id names a component. Empty tables: empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoreloom.llm import blocks as B
from scoreloom.llm.components import components
from scoreloom.llm.shared import written

U = np.uint64
#: Bytes of text that are hashed at once; tokens among which repeats are counted at once.
BLOCK, COUNTED = 1 << 18, 1 << 21
#: A token is frequent if blocks in which it stands SEEN times or more have it FREQUENT times together.
SEEN, FREQUENT, FREQUENT_MOST = 2, 12, 1 << 19
#: A signature of so many nodes gives all their pairs.
SMALL = 24
#: Longs of a sketch; its bits say whether an even or an odd number of the set's tokens falls on each.
SKETCH = 8
#: Bits of the filter that leaves out texts which no pair needs: so many for each text that one needs, and at most.
BITS_EACH, FILTER_BITS = 64, 1 << 27


def _sets(batch: pa.RecordBatch, width: int, text: str = "__text") -> list[np.ndarray]:
    """The distinct tokens of every text, ascending."""
    data, offsets = B.strings(batch.column(text))
    starts, ends, of_text = B.word_spans(data, offsets)
    tokens, at = B.shingle_hashes(B.word_hashes(data, starts, ends), of_text, width)
    return [np.unique(tokens[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _key(tokens: np.ndarray) -> int:
    """64 bits that name a set."""
    return int(B.mix(np.array([B.mix(tokens).sum(dtype=U) + U(len(tokens))], U))[0].astype(np.int64))


def _sketch(tokens: np.ndarray) -> np.ndarray:
    odd = np.bincount((tokens % U(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, U).astype(np.int64))


def nodes(docs: DataFrame, width: int, id: str, text: str) -> DataFrame:
    """(id, filter, tokens, node) for every row; on some rows also tokens that their block repeats, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def repeated(last: bool):
            nonlocal held, size
            if size < COUNTED and not last or not held:
                return [], []
            every = np.sort(np.concatenate(held))
            held, size = [], 0
            cuts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            counts = np.diff(np.append(cuts, len(every)))
            return every[cuts[counts >= SEEN]].astype(np.int64), counts[counts >= SEEN]

        def row(batch, sets, found, counts):
            n = batch.num_rows
            none = [None] * (n - 1)
            return pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("id", "filter")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_key(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([found, *none], pa.list_(pa.int64())),
                    pa.array([counts, *none], pa.list_(pa.int64())),
                ],
                ["id", "filter", "tokens", "node", "repeated", "times"],
            )

        waiting = None
        for batch in B.blocks(batches, "__text", BLOCK):
            sets = _sets(batch, width)
            held.append(np.concatenate(sets))
            size += sum(map(len, sets))
            if waiting:
                yield row(*waiting, [], [])
            waiting = None
            if size >= COUNTED:
                yield row(batch, sets, *repeated(True))
            else:
                waiting = batch, sets
        if waiting:
            yield row(*waiting, *repeated(True))

    kind = docs.schema[id].dataType.simpleString()
    schema = f"id {kind}, filter long, tokens long, node long, repeated array<long>, times array<long>"
    return _input(docs, id, text).mapInArrow(run, schema)


def _input(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.col(id).alias("id"), F.xxhash64(F.col(id)).alias("filter"), F.col(text).alias("__text"))


def _pairs_within(classes: np.ndarray, tokens: np.ndarray, band: int) -> np.ndarray:
    """A signature for every two tokens of one class."""
    order = np.argsort(classes, kind="stable")
    classes, tokens = classes[order], tokens[order]
    first = np.searchsorted(classes, classes, "left")
    before = np.arange(len(classes)) - first  # tokens of the class that come earlier
    second = np.repeat(np.arange(len(classes)), before)
    one = B.ragged(np.arange(len(classes)), first, before)
    return B.mix(B.mix(tokens[one] + U(band + 1)) * U(3) + tokens[second])


def _signatures(tokens: np.ndarray, frequent: np.ndarray, num: int, den: int) -> tuple[list[np.ndarray], list[np.ndarray], int, int]:
    """Signatures and positions (-1 for those of two tokens) of a set, how many rare tokens its prefix has, and where it ends."""
    s = len(tokens)
    lost = s - -(-num * s // den)
    rare = tokens[~frequent]
    if len(rare) > lost:
        return [rare[: lost + 1]], [np.arange(lost + 1)], lost + 1, int((rare[lost : lost + 1] ^ U(1 << 63)).astype(np.int64)[0])
    common = tokens[frequent]
    made, at = [rare], [np.arange(len(rare))]
    low, high = (int(np.log(x) / np.log(den / num) + 1e-9) for x in (s, s * den // num))
    for band in range(low, high + 1):
        classes = B.mix(common) % U(max(1, int((den / num) ** band) // 8))
        order = np.argsort(classes, kind="stable")
        again = np.empty(len(common), bool)  # not the first of its class: makes up for one lost token
        again[order] = np.append(False, classes[order][1:] == classes[order][:-1])
        end = np.searchsorted(np.cumsum(again), lost + 1 - len(rare)) + 1
        pairs = _pairs_within(classes[:end], common[:end], band)
        made.append(pairs)
        at.append(np.full(len(pairs), -1))
    return made, at, len(rare), (1 << 63) - 1


def signatures(docs: DataFrame, frequent: np.ndarray, width: int, num: int, den: int, id: str, text: str) -> DataFrame:
    """(sig, pos, node, tokens) rows; a task gives those of a node once, the first of them with rare, end and sketch.

    `end` is the last rare token that the prefix reaches, in the order of tokens; the greatest long if it reaches all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, done = shared.value, set()
        for batch in B.blocks(batches, "__text", BLOCK):
            sig, pos, node, size, rares, ends, sketches, count = [], [], [], [], [], [], [], []
            for tokens in _sets(batch, width):
                if not len(tokens) or (key := _key(tokens)) in done:
                    continue
                done.add(key)
                at = np.minimum(np.searchsorted(common, tokens), max(len(common) - 1, 0))
                made, places, rare, end = _signatures(tokens, common[at] == tokens if len(common) else np.zeros(len(tokens), bool), num, den)
                if not sum(map(len, made)):
                    continue  # one token: only equal sets are similar enough
                sig += made
                pos += places
                count.append(sum(map(len, made)))
                node.append(key)
                size.append(len(tokens))
                rares.append(rare)
                ends.append(end)
                sketches.append(_sketch(tokens))
            if count:
                first = np.cumsum(count) - count

                def once(x, kind):
                    out = pa.array(np.repeat(np.array(x, kind), count))
                    mask = np.ones(len(out), bool)
                    mask[first] = False
                    return pa.array(out.to_numpy(), mask=mask)

                columns = [_long(np.concatenate(sig)), pa.array(np.concatenate(pos).astype(np.int32)), pa.array(np.repeat(np.array(node, np.int64), count))]
                columns += [pa.array(np.repeat(np.array(size, np.int32), count)), once(rares, np.int32), once(ends, np.int64)]
                of_first = np.zeros(sum(count) + 1, np.int32)
                of_first[first + 1] = SKETCH
                mask = pa.array(of_first[1:] == 0)
                columns.append(pa.ListArray.from_arrays(pa.array(np.cumsum(of_first, dtype=np.int32)), pa.array(np.concatenate(sketches)), mask=mask))
                yield pa.RecordBatch.from_arrays(columns, ["sig", "pos", "node", "tokens", "rare", "end", "sketch"])

    return _input(docs, id, text).mapInArrow(run, "sig long, pos int, node long, tokens int, rare int, end long, sketch array<long>")


def _sized(num: int, den: int) -> str:
    """The overlap that two sets need."""
    return f"cast(ceil({num}L * (l_tokens + r_tokens) / {num + den}.0D - 1e-9) as long)"


def compare(pairs: DataFrame, docs: DataFrame, rows: DataFrame, width: int, num: int, den: int, id: str, text: str) -> DataFrame:
    """Those of the (l, r) pairs that link."""
    needed = pairs.select(F.explode(F.array("l", "r")).alias("node")).distinct()
    chosen = written(rows.join(needed, "node").groupBy("node").agg(F.min("filter").alias("filter")), "needed")
    size = min(FILTER_BITS, max(1 << 16, 1 << (BITS_EACH * chosen.count()).bit_length()))
    bits = np.zeros(size // 8, np.uint8)
    slot = f"pmod(filter, {size})"
    words = chosen.selectExpr(f"cast({slot} div 8 as int) as byte", f"shiftleft(1, cast({slot} % 8 as int)) as bit")
    for found in words.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toLocalIterator():  # at most size / 8 rows
        bits[found["byte"]] = found["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.blocks(batches, "__text", BLOCK):
            place = batch.column("filter").to_numpy() % size
            batch = batch.filter(pa.array((shared.value[place // 8] >> (place % 8).astype(np.uint8)) & 1 == 1))
            if batch.num_rows:
                keys = pa.array([_key(t) if len(t) else None for t in _sets(batch, width)], pa.int64())
                yield pa.RecordBatch.from_arrays([keys, batch.column("__text")], ["node", "text"])

    made = _input(docs, id, text).select("filter", "__text").mapInArrow(texts, "node long, text string")
    # a text is about half as long as its hashes; dealt by node once, and read from there by both joins
    made = made.groupBy("node").agg(F.first("text").alias("text"))  # the few that pass the filter by chance meet no pair

    def sets(part: pa.RecordBatch, side: str) -> list[np.ndarray]:
        _, first, again = np.unique(part.column(side).to_numpy(), return_index=True, return_inverse=True)
        found = _sets(part.take(pa.array(first)), width, f"{side}_text")
        return [found[k] for k in again]

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in B.blocks(B.blocks(batches, "l_text", BLOCK), "r_text", BLOCK):
            keep = np.zeros(part.num_rows, bool)
            for k, (a, b) in enumerate(zip(sets(part, "l"), sets(part, "r"), strict=True)):
                both = np.sort(np.concatenate([a, b]))
                shared = int((both[1:] == both[:-1]).sum())
                keep[k] = den * shared >= num * (len(a) + len(b) - shared)
            yield part.select(["l", "r"]).filter(pa.array(keep))

    with_left = pairs.select("l", "r").join(made.select(F.col("node").alias("l"), F.col("text").alias("l_text")), "l")
    with_both = with_left.join(made.select(F.col("node").alias("r"), F.col("text").alias("r_text")), "r")
    return with_both.select("l", "r", "l_text", "r_text").mapInArrow(overlap, "l long, r long")


def linked(docs: DataFrame, width: int, num: int, den: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, tokens, component) for every row; two times NUM must exceed DEN."""
    if not num < den < 2 * num:
        raise ValueError("the threshold must lie between 1/2 and 1")
    args = (width, num, den, id, text)
    rows = written(nodes(docs, width, id, text), "nodes")
    counted = rows.where("repeated is not null").select(F.explode(F.arrays_zip("repeated", "times")).alias("x"))
    counted = counted.groupBy("x.repeated").agg(F.sum("x.times").alias("times")).where(F.col("times") >= FREQUENT)
    common = counted.orderBy(F.desc("times"), "repeated").limit(FREQUENT_MOST).select("repeated").toPandas()["repeated"]
    made = written(signatures(docs, np.sort(common.to_numpy(np.int64).astype(U)), *args), "signatures")

    # most signatures are of one node: dealt once, they need no tally of their own to be told apart
    of_sig = W.partitionBy("sig")
    around = {"low": F.min("node").over(of_sig), "high": F.max("node").over(of_sig), "many": F.count("*").over(of_sig)}
    # rows that several tasks gave count more than once in `many`; that only sends a signature the other way
    shared = made.selectExpr("sig", "node", "tokens", "least(pos, 0) as pos").withColumns(around).where("low <> high")
    shared = written(shared.groupBy("sig", "node").agg(F.min("pos").alias("pos"), F.first("tokens").alias("tokens"), F.first("many").alias("many")), "shared")
    about = made.where("end is not null").select("node", "rare", "end", "sketch")
    about = written(about.join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "about")

    small = shared.where(F.col("many") <= SMALL)
    side = lambda df, p, *more: df.select("sig", *[F.col(c).alias(f"{p}_{c}") for c in ("node", "pos", *more)])
    need = _sized(num, den)
    # of either side, so that both are dealt alike and only once
    counted = [F.sum((F.least("l_pos", "r_pos") >= 0).cast("int")).alias("met"), F.count("*").alias("both"), *[F.first(c).alias(c) for c in ("l_tokens", "r_tokens")]]
    pairs = side(small, "l", "tokens").join(side(small, "r", "tokens"), "sig").where(f"l_node < r_node and {need} <= least(l_tokens, r_tokens)")
    pairs = pairs.groupBy(F.col("l_node").alias("l"), F.col("r_node").alias("r")).agg(*counted)
    tally = {}
    for name, where in (("large", F.col("many") > SMALL), ("small", F.col("many") <= SMALL)):
        tally |= {f"all_{name}": where, f"in_{name}": where & (F.col("pos") >= 0)}
    known = written(about.drop("sketch").join(shared.groupBy("node").agg(*[F.count_if(where).alias(name) for name, where in tally.items()]), "node"), "known")
    of = lambda p: known.select(F.col("node").alias(p), *[F.col(c).alias(f"{p}_{c}") for c in ("rare", "end", *tally)])

    few_rare = f"{need} <= least(l_tokens - l_rare, r_tokens - r_rare)"  # enough tokens besides the rare ones

    def possible(pairs: DataFrame, others: str, all_counted: str = "true") -> DataFrame:
        """Of (l, r, met, both, l_tokens, r_tokens) those that can link.

        Of the prefix that ends first, every token that is not in the other prefix is missing there. `met` counts the shared rare
        tokens among some signatures, `both` all shared signatures among them; `others` says where each node's other ones are counted.
        Where `all_counted` is false, `both` lacks shared signatures of two tokens and bounds nothing.
        Rare tokens: counted one by one. Frequent ones: of a class with n in the prefix and m shared, m - 1 are at most the
        shared pairs, and all n - 1 add up to what is left of the tokens that a partner may miss, and one more.
        """
        pairs = pairs.join(of("l"), "l").join(of("r"), "r")
        test = "({p}_end > {q}_end or {p}_rare - met - least(l_in_" + others + ", r_in_" + others + ") <= {p}_tokens - " + need + ")"
        pairs = pairs.where(test.format(p="l", q="r") + " and " + test.format(p="r", q="l"))
        # which of two prefixes with frequent tokens ends first is not known here: one of them has to pass
        test = f"({{p}}_tokens - ceil({num}L * {{p}}_tokens / {den}.0D - 1e-9) + 1 - both - least(l_all_{others}, r_all_{others}) <= {{p}}_tokens - {need})"
        return pairs.where(f"not ({all_counted}) or l_end <> r_end or l_end <> {(1 << 63) - 1}L or " + test.format(p="l") + " or " + test.format(p="r")).select("l", "r")

    first = possible(pairs, "large")

    hot = shared.where(F.col("many") > SMALL).join(about, "node")
    centres = hot.groupBy("sig").agg(F.min(F.struct("rare", (-F.col("tokens")).alias("fewer"), "node", "tokens")).alias("c"))
    centres = centres.select("sig", F.col("c.rare").alias("r_rare"), F.col("c.node").alias("r_node"), F.col("c.tokens").alias("r_tokens"))
    # signatures of two tokens: rare tokens that both had would be signatures themselves
    fits = f"{need} <= least(l_tokens, r_tokens) and (l_pos >= 0 or {few_rare})"
    star = side(hot, "l", "tokens", "rare").join(centres, "sig").where("l_node <> r_node").where(fits)
    star = star.select(F.least("l_node", "r_node").alias("l"), F.greatest("l_node", "r_node").alias("r"))
    first = written(first.unionAll(star).distinct(), "pairs")
    links = written(compare(first, docs, rows, *args), "links")
    found = components(links.select(F.col("l").alias("a"), F.col("r").alias("b")))

    placed = hot.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    placed = placed.join(open_, "sig")
    columns = ("tokens", "rare", "component", "sketch")
    differ = " + ".join(f"bit_count(l_sketch[{k}] ^ r_sketch[{k}])" for k in range(SKETCH))
    rest = side(placed, "l", *columns).join(side(placed, "r", *columns), "sig").where("l_node < r_node and l_component <> r_component").where(fits)
    rest = rest.where(f"l_tokens + r_tokens - ({differ}) >= 2 * {need}")
    rest = rest.groupBy(F.col("l_node").alias("l"), F.col("r_node").alias("r")).agg(*counted)
    rest = written(possible(rest, "small", few_rare).join(first, ["l", "r"], "left_anti"), "pairs")
    if rest.limit(1).count():
        links = links.unionAll(compare(rest, docs, rows, *args))

    # the least id of every node, then of every component; ids of one row each with several texts join their nodes
    named = rows.select("id", "tokens", "node")
    several = named.where("id is not null and node is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    joined = named.join(several.select("id", "a"), "id").select("a", F.col("node").alias("b"))
    found = components(links.select(F.col("l").alias("a"), F.col("r").alias("b")).unionAll(joined))
    ids = named.where("node is not null").groupBy("node").agg(F.min("id").alias("least"))
    of_node = ids.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = of_node.groupBy("component").agg(F.min("least").alias("least_id"))
    of_node = of_node.join(least, "component").select("node", "least_id")
    return named.join(of_node, "node", "left").select(
        "id", "tokens", F.when(F.col("id").isNotNull(), F.coalesce("least_id", "id")).alias("component")
    )


def statement(width: int, num: int, den: int) -> str:
    """Ids, set sizes and components over a table `documents` in SQL: every pair that shares a run, then everything reachable."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    run = f"CASE WHEN len(w) < {width} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[k : k + {width - 1}], ' ') for k in range(1, len(w) - {width} + 2)] END"
    return f"""WITH RECURSIVE worded AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct({run}) END AS s FROM worded),
        runs AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS r FROM sets),
        links AS MATERIALIZED (
            SELECT a.doc_id AS a, b.doc_id AS b FROM runs a JOIN runs b ON a.r = b.r AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
        reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.least AS component_id
        FROM sets s JOIN (SELECT a, min(b) AS least FROM reached GROUP BY a) c ON c.a = s.doc_id"""
