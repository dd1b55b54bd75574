"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is its words (see blocks.py), A-Z as a-z, and one end. The model spells every word byte by byte and closes it with a mark;
the end is a symbol of its own. Each symbol is a path of binary decisions in a Huffman tree. For each decision every
predictor looks up, under the hash of its context and the tree node, how often either bit followed there in the training texts:

    the last two bytes of the word, the last four, the whole word so far,

each together with the group that the words before it speak for. Groups are the values of a column of the training texts, such as
the language; how often each of the FREQUENT most common words stands in each group weighs the words of a text as
they come, and the group ahead so far is the context of the next word. Scoring reads the text alone.

Counts of all training texts are gathered in tables of fixed size by hash, merged over tasks in two steps; every word counts in
each of them, however rare. Every value of the column is a group; more than GROUPS of them are an error. The predictions are
stretched (log odds) and mixed with weights of the decision's gate, which is set by how much the two longest contexts have
been seen. Weights are learned online in the same pass: a task counts a portion of decisions, predicts
it as if the predicted word had not been counted (leave one out), and moves the weights along the
gradient; tasks are averaged by the decisions of each gate. What followed each mixed prediction is counted too and
refines the final probability. Since contexts lie within a word, a block is computed on its distinct words by group, what these begin
with alike only once, and a task that scores keeps the results of up to REMEMBERED of them for its next blocks.

The base score is the unigram model's: counts of all words are summed in Spark; the FREQUENT most common are sent to
the tasks, all other words of a text are looked up by a join. Words are identified by their 64-bit hash.

Cases. Null and empty texts: the end alone. Null ids: whatever `training` says of them. Very long texts: whole, a block of their own.
Repeated rows: each gets its row. Without training texts the counts are empty, the model is uniform over decisions.
Ties among equally frequent words only decide which are sent along. Empty tables: empty result. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import blocks as B
from scoreloom.llm.shared import written

U = np.uint64
#: Bytes of text in a block, of those hashed at once; decisions computed at once.
BLOCK, HASHED, DECISIONS = 3 << 20, 1 << 19, 1 << 17
#: Table sizes of the predictors in bits; slots of a chunk in bits; chunks are merged in two steps of so many.
BITS, CHUNK_BITS, STEP = (18, 21, 23), 17, 8
FREQUENT = 1 << 17
CLOSE, END = 256, 257
#: Groups at most; more are refused, none is left out.
GROUPS = 256
#: Symbols that two numbers hold when words are sorted; from this place on a symbol is computed for each word.
SORTED, DEEP = 7, 255
#: Scores of words by group that a task keeps.
REMEMBERED = 1 << 20
END_WORD = -1  # stands for the end among word hashes
GATES, LEVELS, PRIOR = 15, 48, 0.4
RATE, DAMPING = 0.1, 0.02


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For symbols with these counts: length and start of each path, and nodes and bits of all paths."""
    heap = [(int(c) + 1, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, n = {}, len(counts)
    inner = n
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        parent[x], parent[y] = (inner, 0), (inner, 1)
        heapq.heappush(heap, (a + b, inner))
        inner += 1
    lengths, nodes, bits = [], [], []
    for s in range(n):
        path = []
        while s in parent:
            s, bit = parent[s]
            path.append((s - n, bit))
        lengths.append(len(path))
        nodes += [node for node, _ in reversed(path)]
        bits += [bit for _, bit in reversed(path)]
    lengths = np.array(lengths)
    return lengths, np.cumsum(lengths) - lengths, np.array(nodes, U), np.array(bits, np.int64)


class Words:
    """The distinct words of a block and where they stand."""

    def __init__(self, table: pa.Table):
        data, starts, ends, hashes, counts = [], [], [], [], []
        shift = 0
        self.bytes = np.zeros(table.num_rows, np.int64)
        done = 0
        for batch in table.to_batches():
            for part in B.blocks(iter([batch]), "text", HASHED):
                piece, offsets = B.strings(part.column("text"))
                s, e, of_text = B.word_spans(piece, offsets)
                hashes.append(B.word_hashes(piece, s, e))
                starts.append(s + shift)
                ends.append(e + shift)
                counts.append(np.diff(of_text))
                data.append(B.lowered(piece))
                self.bytes[done : done + part.num_rows] = np.diff(offsets)
                shift += len(piece)
                done += part.num_rows
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        every = join(hashes, U)
        order = np.argsort(every)  # any of equal words will do, so the sort need not be stable
        every = every[order]
        fresh = np.append(True, every[1:] != every[:-1])[: len(every)]
        at = order[fresh]
        self.hashes, self.times = every[fresh], np.diff(np.append(np.flatnonzero(fresh), len(every)))
        self.word = np.empty(len(every), np.int64)
        self.word[order] = np.cumsum(fresh) - 1
        self.of_text = join(counts, np.int64)
        self.text_of = np.repeat(np.arange(table.num_rows), self.of_text)
        self.starts = join(starts, np.int64)[at]
        self.lengths = join(ends, np.int64)[at] - self.starts
        self.data = join(data, np.uint8)

    def byte_counts(self) -> np.ndarray:
        """How often each byte stands in the words of the texts."""
        counts = np.bincount(self.data, minlength=256)
        counts[~B._IS_WORD] = 0
        return counts

    def spell(self, common: np.ndarray, weights: np.ndarray, scored: np.ndarray | None = None) -> None:
        """Distinct words by the group ahead before them, spelled and closed by a mark, then the ends of texts by group.

        Sets `symbols`, `place` in the word, `begin` of each entry, its `group` and `uses`, `entry` of each word that stands in the
        texts and `last` of each text; `weights` are those of the sorted `common` words for each group. Sets `keys` of all words
        by group and `found`, their places in the sorted `scored` ones; only those that are not there (-1) are spelled.
        """
        groups = weights.shape[1]
        ahead = self._ahead(find(common, _signed(self.hashes)), weights)
        group, last = np.split(ahead, [len(self.word)])
        pairs, self.entry, uses = _distinct(self.word * (groups + 1) + group, len(self.hashes) * (groups + 1))
        self.last = len(pairs) + last
        which, group = pairs // (groups + 1), pairs % (groups + 1)
        self.keys = B.mix(self.hashes[which] + group.astype(U) * U(0x9E3779B97F4A7C15))
        self.found = np.full(len(pairs), -1) if scored is None else find(scored, self.keys)
        fresh = self.found < 0
        which, group, uses = which[fresh], group[fresh], uses[fresh]
        lengths = self.lengths[which]
        self.group = np.append(group, np.arange(groups + 1))
        self.uses = np.append(uses, np.bincount(last, minlength=groups + 1))
        self.word_of = np.append(which, np.full(groups + 1, -1))
        spelled = int(lengths.sum()) + len(lengths)
        self.begin = np.append(np.cumsum(lengths + 1) - lengths - 1, spelled + np.arange(groups + 1))
        self.symbols = np.full(spelled + groups + 1, CLOSE, np.int16)
        place = np.arange(spelled, dtype=np.int32)
        place -= np.repeat(self.begin[: len(lengths)].astype(np.int32), lengths + 1)
        inside = np.flatnonzero(place < np.repeat(lengths, lengths + 1))
        self.symbols[inside] = B.ragged(self.data, self.starts[which], lengths)
        self.symbols[spelled:] = END
        self.place = np.append(place, np.zeros(groups + 1, np.int32))

    def _ahead(self, known: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The group ahead before every word and at the end of every text; the number of groups where none has been spoken for."""
        starts = np.append(0, np.cumsum(self.of_text))
        groups = weights.shape[1]
        ahead, spoken = np.zeros(len(self.word) + len(self.of_text), np.int64), np.zeros(len(self.word) + len(self.of_text), bool)
        most, sums = None, np.zeros(len(self.word) + 1, np.float32)
        for g in range(groups):  # a group at a time, so that memory does not grow with them
            voice = np.where(known >= 0, weights[:, g].take(known, mode="clip"), np.float32(0)) if len(weights) else np.zeros(len(known), np.float32)
            np.cumsum(voice[self.word], out=sums[1:])
            at = sums[starts]
            now = np.concatenate([sums[:-1] - np.repeat(at[:-1], self.of_text), at[1:] - at[:-1]])
            spoken |= now != 0
            if most is not None:
                ahead[now > most] = g
                np.maximum(most, now, out=now)
            most = now
        ahead[~spoken] = groups
        return ahead

    def shared(self) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that follow a beginning for the first time in its group, ascending; for every symbol, which of them it repeats.

        Entries are sorted; a symbol repeats that of the entry before as long as both began alike. The sort looks at the first
        symbols only, so some that begin alike for longer are computed twice, with the same result.
        """
        lengths, count = np.diff(np.append(self.begin, len(self.symbols))), len(self.symbols)
        symbols = self.symbols
        keys = [np.zeros(len(lengths), np.int64) for _ in range(2)]
        for k in range(2 * SORTED):
            there = symbols.take(self.begin + k, mode="clip") + np.int16(1)
            there[lengths <= k] = 0
            keys[k // SORTED] *= 512
            keys[k // SORTED] += there
        order = np.lexsort((keys[1], keys[0], self.group))
        begin, length = self.begin[order], lengths[order]
        alike = self._alike(symbols, begin, length, self.group[order], [key[order] for key in keys])
        fewer = np.empty(len(order), np.int64)
        fewer[order] = alike
        first = self.place >= np.repeat(fewer, lengths)
        # of the symbols from the place on where an entry differs, each is the next one
        number = (np.cumsum(lengths - fewer) - lengths)[order]
        which = np.empty(count, np.int32)
        which[first] = np.arange(np.count_nonzero(first), dtype=np.int32)
        # place by place, in sorted order: what repeats a symbol stands right behind it
        for place in range(int(alike.max(initial=0))):
            if place:
                there = np.flatnonzero(length > place)
                begin, length, alike, number = (x[there] for x in (begin, length, alike, number))
            fresh = np.flatnonzero(alike <= place)
            which[begin + place] = np.repeat(number[fresh] + place, np.diff(np.append(fresh, len(begin))))
        return np.flatnonzero(first), which

    def _alike(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray, group: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
        """For sorted entries, how many symbols each begins alike with the one before, DEEP at most."""
        alike = np.zeros(len(begin), np.int64)
        go_on = np.append(False, group[1:] == group[:-1])[: len(begin)]
        for key in keys:
            differ = np.append(0, key[1:] ^ key[:-1])[: len(begin)]
            for k in range(SORTED):
                alike += go_on & (differ < 512 ** (SORTED - 1 - k))
            go_on &= differ == 0
        there = np.flatnonzero(go_on)  # alike as far as the keys go
        shorter = np.minimum(length[there], length[there - 1])
        for place in range(len(keys) * SORTED, DEEP):
            on = shorter > place
            there, shorter = there[on], shorter[on]
            same = symbols[begin[there] + place] == symbols[begin[there - 1] + place]
            there, shorter = there[same], shorter[same]
            if not len(there):
                break
            alike[there] += 1
        return alike

    def contexts(self, at: np.ndarray | None = None) -> list[np.ndarray]:
        """For each predictor the hash of the context of every symbol, or of those at ascending positions."""
        at = np.arange(len(self.symbols)) if at is None else at
        s, place = self.symbols + np.int16(1), self.place[at]
        word = np.repeat(np.arange(len(self.begin), dtype=np.int32), np.diff(np.append(self.begin, len(s))))[at]
        group = (self.group[word].astype(U) + U(1)) * U(0x9E3779B97F4A7C15)
        out, now = [], np.zeros(len(at), U)
        for back in range(1, 5):
            now = now * U(512) + np.where(place >= back, s.take(at - back, mode="clip"), np.int16(0)).astype(U)
            if back in (2, 4):
                out.append(B.mix(now + group + U(back << 60)))
        data = np.minimum(self.symbols, 255).astype(np.uint8)
        whole = np.empty(len(at), U)
        for a, b in _spans(self.begin, len(s), HASHED):  # word by word, so that powers stay few
            part = slice(*np.searchsorted(at, (a, b)))
            whole[part] = B.word_hashes(data[a:b], self.begin[word[part]] - a, at[part] - a)
        out.append(B.mix(whole + place.astype(U)) + group)
        return out


def _distinct(values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole numbers from 0 below `end`: the distinct ones, which of them each is, how often each stands there."""
    if end > 4 * len(values):
        return np.unique(values, return_inverse=True, return_counts=True)
    times = np.bincount(values, minlength=end)
    there = np.flatnonzero(times)
    return there, (np.cumsum(times > 0) - 1)[values], times[there]


def find(common: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in the sorted `common`, -1 if they aren't there."""
    if not len(common):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
    return np.where(common[at] == keys, at, -1)


def _spans(begin: np.ndarray, end: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole words of about `most` symbols."""
    a = 0
    while a < end:
        k = np.searchsorted(begin, a + most, "right")
        b = int(begin[k]) if k < len(begin) else end
        yield a, b
        a = b


def decisions(words: Words, code, only: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
    """In portions: the word and the bit of each decision, and its slot in each table.

    Of the symbols at the ascending positions `only`: which of them instead of the word, in as many portions as all symbols make.
    """
    lengths, starts, nodes, bits = code
    asked = np.arange(len(words.symbols)) if only is None else only
    contexts = words.contexts(asked)
    ends = np.cumsum(lengths[words.symbols])
    size, first = lengths[words.symbols[asked]], starts[words.symbols[asked]]
    if only is None:
        word = np.repeat(np.arange(len(words.begin)), np.diff(np.append(words.begin, len(words.symbols))))
    else:
        word = np.arange(len(only))
    spreads = (nodes + U(1)) * U(0x9E3779B97F4A7C15)
    done = 0
    while done < len(ends):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + DECISIONS, "right")))
        a, b = np.searchsorted(asked, (done, upto))
        n = size[a:b]
        of = np.repeat(word[a:b], n)
        step = np.arange(len(of))
        step += np.repeat(first[a:b] - np.cumsum(n) + n, n)
        spread, slots = spreads.take(step), []
        for c, bit in zip(contexts, BITS, strict=True):
            slot = np.repeat(c[a:b], n)
            slot ^= spread
            slot *= U(0xC4CEB9FE1A85EC53)
            slot >>= U(64 - bit)
            slots.append(slot.view(np.int64))
        yield of, bits.take(step), slots
        done = upto


def _start() -> np.ndarray:
    return np.full((GATES, len(BITS)), 0.4)


def _flat() -> np.ndarray:
    """Sums of the curvature along each weight by gate, and of portions, before the first."""
    return np.zeros((len(BITS) + 1, GATES))


#: Level of how often a context has been seen, by that count up to 16; levels of the whole word and of the last four bytes make the gate.
_BOUNDS, _BOUNDS_FOUR = (0.5, 1.5, 3.5, 15.5), (0.5, 3.5)
_SEEN = np.searchsorted(_BOUNDS, np.arange(17)).astype(np.int64)
_SEEN_FOUR = np.searchsorted(_BOUNDS_FOUR, np.arange(17)).astype(np.int64)
ONE = np.float32(1)


def halves(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of either bit in 16 bits; large ones are scaled down together."""
    scale = np.maximum(pairs.max(1) / 32000, 1)
    return (pairs[:, 0] / scale).astype(np.float16), (pairs[:, 1] / scale).astype(np.float16)


def _left_out(table: np.ndarray, slot: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and count of a context, as if the decision's own word, `own` as in `_counted`, had been counted once less."""
    both = table.view(U).take(slot)
    both -= own
    odds = both.view(np.uint32).astype(np.float32)  # the two counts of a slot lie side by side
    seen = odds[::2] + odds[1::2]
    odds += np.float32(PRIOR)
    ratio = odds[1::2] / odds[::2]
    return np.log(ratio, out=ratio), seen


def _counted(times: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Both counts of a slot, as a table has them side by side: `times` of the bit, none of the other."""
    return times << (bit.view(U) << U(5))


def _gate(seen: np.ndarray, seen_four: np.ndarray) -> np.ndarray:
    gate = np.zeros(len(seen), np.int8)
    for bound in _BOUNDS:
        gate += seen > np.float32(bound)
    gate *= 3
    for bound in _BOUNDS_FOUR:
        gate += seen_four > np.float32(bound)
    return gate.astype(np.int64)


def _stretched(table: tuple[np.ndarray, np.ndarray], levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds and level of every slot."""
    zero, one = (x.astype(np.float32) for x in table)
    return np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR))).astype(np.float16), levels[np.minimum(zero + one, 16).astype(np.int64)].astype(np.uint8)


def _mixed(stretched: list[np.ndarray], weights: np.ndarray, gate: np.ndarray) -> np.ndarray:
    mix = np.zeros(len(gate), np.float32)
    for k, x in enumerate(stretched):
        mix += weights[:, k].astype(np.float32).take(gate) * x
    return np.clip(mix, -12, 12, out=mix)


def _level(mix: np.ndarray) -> np.ndarray:
    return ((mix + np.float32(12)) * np.float32(LEVELS / 24.001)).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def learned(portion, times_of: np.ndarray, listed: np.ndarray | None, counts: list, weights: np.ndarray, mass: np.ndarray, followed: np.ndarray, steep_sums: np.ndarray) -> None:
    """Move the weights along a portion of decisions; add to the decisions of each gate and to the bits that followed each mix.

    A decision may stand for very many words, so portions weigh unlike: a step is measured by the mean portion so far, not by its own.
    """
    word, bit, slots = portion
    times, bits = times_of.take(word), bit.astype(np.float32)
    own = _counted((times > 0).astype(U), bit)  # what none stands for was not counted
    counted = (own, own, own if listed is None else own * listed.take(word))
    stretched, seen = zip(*[_left_out(t, slot, c) for t, slot, c in zip(counts, slots, counted, strict=True)], strict=True)
    gate = _gate(seen[2], seen[1])
    mix = _mixed(stretched, weights, gate)
    one = _sigmoid(mix)
    wrong, steep = times * (bits - one), times * one * (ONE - one)
    mass += np.bincount(gate, times, GATES)
    steep_sums[-1] += 1  # portions
    for k, x in enumerate(stretched):  # a damped Newton step along each weight
        steep_sums[k] += np.bincount(gate, steep * x * x, GATES)
        weights[:, k] += RATE * np.bincount(gate, wrong * x, GATES) / np.maximum((steep_sums[k] + DAMPING * mass) / steep_sums[-1], 1)
    followed += np.bincount((gate * LEVELS + _level(mix)) * 2 + bit, times, GATES * LEVELS * 2)


def gather(words: Words, code, times: np.ndarray, is_listed: np.ndarray, tables: list, weights: np.ndarray, mass: np.ndarray, followed: np.ndarray, steep_sums: np.ndarray | None = None) -> None:
    """Count every portion of a block's decisions in the tables and learn from it."""
    steep_sums = _flat() if steep_sums is None else steep_sums
    only, which = words.shared()
    spelled = np.diff(np.append(words.begin, len(words.symbols)))
    # a decision that several words share counts as often as all of them
    shared = lambda x: np.bincount(which, np.repeat(x, spelled), len(only)).astype(U)
    every = shared(times)
    listed = None if is_listed.all() else shared(times * is_listed)
    uses, own = every.astype(np.float32), None if listed is None else (listed > 0).astype(U)
    for portion in decisions(words, code, only):
        word, bit, slots = portion
        value = _counted(every.take(word), bit)
        values = (value, value, value if listed is None else _counted(listed.take(word), bit))
        for table, slot, value in zip(tables, slots, values, strict=True):
            np.add.at(table.view(U), slot, value)
        learned(portion, uses, own, tables, weights, mass, followed, steep_sums)


def spelled(words: Words, code, tables: list, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
    """log10 of the probability of each distinct word, the end last; `tables` as from _stretched."""
    only, which = words.shared()
    out = np.zeros(len(only))
    refined = refined.astype(np.float32)
    for symbol, bit, slots in decisions(words, code, only):
        gate = (tables[2][1].take(slots[2]) * np.uint8(3) + tables[1][1].take(slots[1])).astype(np.int64)
        mix = _mixed([t[0].take(slot).astype(np.float32) for t, slot in zip(tables, slots, strict=True)], weights, gate)
        one = np.float32(0.5) * (_sigmoid(mix) + refined.take(gate * LEVELS + _level(mix)))
        one = np.clip(np.where(bit == 1, one, ONE - one), np.float32(1e-6), ONE)
        if len(symbol):  # a portion has its symbols side by side
            part = out[symbol[0] : symbol[-1] + 1]
            part += np.bincount(symbol - symbol[0], np.log10(one), len(part))
    spelled = np.diff(np.append(words.begin, len(words.symbols)))
    return np.bincount(np.repeat(np.arange(len(spelled)), spelled), out[which], len(spelled))


class Remembered:
    """log10 of the probability of words by group, from the blocks that a task has scored: the same word gets the same."""

    def __init__(self) -> None:
        self.keys, self.logs = np.zeros(0, U), np.zeros(0)

    def score(self, words: Words, code, tables: list, weights: np.ndarray, refined: np.ndarray) -> np.ndarray:
        """Of every word by group of a spelled block, then of the ends."""
        new = spelled(words, code, tables, weights, refined)
        fresh = words.found < 0
        n = int(fresh.sum())
        logs = np.empty(len(fresh))
        logs[fresh], logs[~fresh] = new[:n], self.logs[words.found[~fresh]]
        if len(self.keys) + n > REMEMBERED:
            self.keys, self.logs = np.zeros(0, U), np.zeros(0)
        if n <= REMEMBERED:
            keys, values = np.append(self.keys, words.keys[fresh]), np.append(self.logs, new[:n])
            order = np.argsort(keys, kind="stable")
            self.keys, self.logs = keys[order], values[order]
        return np.append(logs, new[n:])


def _is_listed(words: Words, common: np.ndarray) -> np.ndarray:
    """Whether each entry is a common word or an end."""
    return np.append(find(common, _signed(words.hashes)) >= 0, True)[words.word_of]


def _gathered(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple[pa.Table, Words]]:
    for table in B.gathered(batches, "text", BLOCK):
        table = table.combine_chunks()
        yield table, Words(table)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(np.int64)


def word_counts(training: DataFrame, groups: int) -> DataFrame:
    """(kind, key, times, g0, g1, ...): words by hash and the end (kind 0) with their times by group, symbols (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, words in _gathered(batches):
            group = table.column("group").to_numpy()
            by_group = np.bincount(words.word * (groups + 1) + group[words.text_of], minlength=len(words.hashes) * (groups + 1)).reshape(-1, groups + 1)
            symbols = np.append(words.byte_counts(), [len(words.word), table.num_rows])
            key = np.concatenate([_signed(words.hashes), [END_WORD], np.arange(END + 1)])
            times = np.concatenate([words.times, [table.num_rows], symbols]).astype(np.int64)
            kind = np.repeat([0, 1], [len(words.hashes) + 1, END + 1]).astype(np.int32)
            extra = np.zeros((END + 2, groups), np.int64)
            columns = [kind, key, times, *np.concatenate([by_group[:, :groups], extra]).T]
            for start in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c[start : start + (1 << 16)])) for c in columns], names)

    sums = [f"g{g}" for g in range(groups)]
    names = ["kind", "key", "times", *sums]
    made = training.mapInArrow(run, "kind int, " + ", ".join(f"{n} long" for n in names[1:]))
    return written(made.groupBy("kind", "key").agg(*[F.sum(n).alias(n) for n in names[2:]]), "counts")


def _packed(counts: np.ndarray) -> bytes:
    return pa.Codec("zstd", compression_level=1).compress(counts, asbytes=True)


def _unpacked(chunk: bytes) -> np.ndarray:
    """Counts of a chunk: 4 bytes each from a task, 8 once merged."""
    data = pa.input_stream(pa.py_buffer(chunk), compression="zstd").read()
    return np.frombuffer(data, np.uint32 if len(data) == 8 << CHUNK_BITS else np.float64)


def _merged(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of chunks with equal keys."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 << CHUNK_BITS)
        for batch in batches:
            for value in batch.column("chunk"):
                total += _unpacked(value.as_py())
        values = [pa.array([k.as_py()], pa.int32()) for k in key]
        yield pa.RecordBatch.from_arrays([*values, pa.array([_packed(total)], pa.binary())], [*keys, "chunk"])

    return chunks.groupBy(*keys).applyInArrow(run, ", ".join(f"{k} int" for k in keys) + ", chunk binary")


def context_counts(training: DataFrame, code, common: np.ndarray, voices: np.ndarray) -> tuple[list, np.ndarray, np.ndarray]:
    """Over all training texts: for each predictor a table of how often either bit followed; weights by gate; the probability
    of a one after every mixed prediction."""
    shared = training.sparkSession.sparkContext.broadcast((code, common, voices))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, common, voices = shared.value
        tables = [np.zeros(2 << bits, np.uint32) for bits in BITS]
        weights, mass, followed, steep_sums = _start(), np.zeros(GATES), np.zeros(GATES * LEVELS * 2), _flat()
        for _, words in _gathered(batches):
            words.spell(common, voices)
            times, every = words.uses.astype(np.uint32), np.ones(len(words.uses), bool)
            gather(words, code, times, every, tables, weights, mass, followed, steep_sums)
        step = TaskContext.get().partitionId() % STEP
        row = lambda k, c, content: pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (k, c, step)] + [pa.array([content], pa.binary())], names)
        for k, table in enumerate(tables):
            for c, chunk in enumerate(table.reshape(-1, 2 << CHUNK_BITS)):
                if chunk.any():
                    yield row(k, c, _packed(chunk))
        learnt = np.zeros(2 << CHUNK_BITS)
        found = np.concatenate([(weights * mass[:, None]).ravel(), mass, followed])
        learnt[: len(found)] = found
        yield row(len(BITS), 0, _packed(learnt))

    names = ["predictor", "place", "step", "chunk"]
    chunks = training.mapInArrow(run, "predictor int, place int, step int, chunk binary")
    chunks = _merged(_merged(chunks, ["predictor", "place", "step"]).drop("step"), ["predictor", "place"])
    out = [(np.zeros(1 << bits, np.float16), np.zeros(1 << bits, np.float16)) for bits in BITS]
    sums = np.zeros(GATES * (len(BITS) + 1 + LEVELS * 2))
    for row in written(chunks, "tables").toLocalIterator():  # a chunk at a time, as many as the tables have
        values = _unpacked(bytes(row["chunk"]))
        if row["predictor"] == len(BITS):
            sums = values[: len(sums)]
            continue
        place = slice(row["place"] << CHUNK_BITS, (row["place"] + 1) << CHUNK_BITS)
        for table, half in zip(out[row["predictor"]], halves(values.reshape(-1, 2)), strict=True):
            table[place] = half
    weighted, mass, followed = np.split(sums, [GATES * len(BITS), GATES * (len(BITS) + 1)])
    weights = np.where(mass[:, None] > 0, weighted.reshape(GATES, -1) / np.maximum(mass, 1)[:, None], _start())
    followed = followed.reshape(-1, 2)
    centre = np.tile(_sigmoid((np.arange(LEVELS) + 0.5) * (24 / LEVELS) - 12), GATES)  # where nothing followed, the mix itself
    return out, weights, (followed[:, 1] + 4 * centre) / (followed.sum(1) + 4)


def voices_of(times: np.ndarray, by_group: np.ndarray) -> np.ndarray:
    """How much each word speaks for each group: log of its share there over its share in all, smoothed."""
    share = (by_group + 0.5 * by_group.sum(0) / max(by_group.sum(), 1)) / np.maximum(by_group.sum(0), 1)
    share = np.maximum(share, 1e-300)  # a group may have blank texts only
    return np.log(share / np.maximum(share.mean(1, keepdims=True), 1e-300)).astype(np.float32) if by_group.shape[1] else by_group.astype(np.float32)


def score(docs: DataFrame, training: Column, group: str | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, trains, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    `group`: a column of the training texts whose values share words, such as the language.
    """
    spark = docs.sparkSession
    label = F.col(group).cast("string") if group else F.lit(None).cast("string")
    rows = docs.select(F.col(id).alias("id"), training.alias("trains"), F.coalesce(F.col(text), F.lit("")).alias("text"), label.alias("label"))
    learn = rows.where("trains")
    most = learn.where("label is not null").groupBy("label").count().orderBy(F.desc("count"), "label").limit(GROUPS + 1).collect()
    if len(most) > GROUPS:
        raise ValueError(f"{group} has more than {GROUPS} values; group the texts more coarsely")
    place = F.lit(len(most))
    for g, row in enumerate(most):
        place = F.when(F.col("label") == row["label"], g).otherwise(place)
    learn = learn.select("text", F.coalesce(place, F.lit(len(most))).cast("int").alias("group"))
    counts = word_counts(learn, len(most))
    totals = counts.where("kind = 0").agg(F.count("*").alias("distinct"), F.sum("times").alias("all")).first()
    distinct, all_ = totals["distinct"], totals["all"] or 0
    symbols = np.zeros(END + 1)
    for row in counts.where("kind = 1").select("key", "times").collect():  # as many as there are symbols
        symbols[row["key"]] = row["times"]
    code = huffman(symbols)
    sums = [f"g{g}" for g in range(len(most))]
    top = counts.where("kind = 0").orderBy(F.desc("times"), "key").limit(FREQUENT).select("key", "times", *sums).toArrow()
    order = np.argsort(top.column("key").to_numpy())
    common, common_times = top.column("key").to_numpy()[order], top.column("times").to_numpy()[order]
    voices = voices_of(common_times, np.stack([top.column(g).to_numpy()[order] for g in sums], 1).astype(float) if sums else np.zeros((len(order), 0)))
    tables, weights, refined = context_counts(learn, code, common, voices)
    tables = [_stretched(t, levels) for t, levels in zip(tables, (_SEEN, _SEEN_FOUR, _SEEN), strict=True)]
    shared = spark.sparkContext.broadcast((code, tables, weights, refined, common, common_times, voices))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, tables, weights, refined, common, common_times, voices = shared.value
        row, remembered = TaskContext.get().partitionId() << 40, Remembered()
        for table, words in _gathered(batches):
            words.spell(common, voices, remembered.keys)
            logs = remembered.score(words, code, tables, weights, refined)
            keys = np.append(_signed(words.hashes), END_WORD)
            at = find(common, keys)
            times = np.where(at >= 0, common_times[np.maximum(at, 0)], 0) if len(common) else np.zeros(len(keys), np.int64)
            base = np.log10(times + 1.0)
            n = table.num_rows
            sums = lambda x: np.bincount(words.text_of, x[words.word], n) + x[-1]
            rare = at[words.word] < 0
            offsets = np.append(0, np.cumsum(np.bincount(words.text_of[rare], minlength=n))).astype(np.int32)
            rares = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[words.word[rare]]))
            spelling = np.bincount(words.text_of, logs[words.entry], n) + logs[words.last]
            columns = [
                pa.array(row + np.arange(n)), table.column("id").combine_chunks(), table.column("trains").combine_chunks(), pa.array(words.of_text + 1),
                pa.array(sums((times > 0).astype(float)).astype(np.int64)), pa.array(sums(base)), pa.array(spelling), pa.array(words.bytes), rares,
            ]
            names = ["row", "id", "trains", "n_tokens", "known", "base", "score", "bytes", "rare"]
            columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
            batch = pa.RecordBatch.from_arrays(columns, names)
            for start in range(0, n, 512):
                yield batch.slice(start, 512)
            row += n

    schema = f"row long, id {kind}, trains boolean, n_tokens long, known long, base double, score double, bytes long, rare array<long>"
    scored = written(rows.mapInArrow(run, schema), "scored")
    asked = scored.select("row", F.explode("rare").alias("key"))
    found = asked.join(counts.where("kind = 0").select("key", "times"), "key")
    found = found.groupBy("row").agg(F.sum(F.log10(F.col("times") + 1.0)).alias("more"), F.count("*").alias("also"))
    whole = scored.drop("rare").join(found, "row", "left")
    each = float(np.log10(all_ + distinct + 1.0))
    return whole.select(
        "id",
        "trains",
        "n_tokens",
        (F.col("known") + F.coalesce("also", F.lit(0))).alias("n_known"),
        F.lit(all_).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
        "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
