"""Language-model scoring by masked pseudo-likelihood.

A small bidirectional network sees WINDOW words on both sides of a masked word and predicts it; the sum of the log
conditional probabilities of all words of a text scores the document.

The network knows CLASSES * MEMBERS ids: the OWN most frequent words have one each, all others share the rest by hash. The
hidden layer is the tanh of the neighbours' vectors, each scaled by its place; the id's class is predicted from it, then its
member from the hidden layer and the class, so the probabilities of all ids add up to 1. A word's probability is its id's
times its part of the occurrences of that id's words in the corpus, by a count of every word of the corpus; one occurrence
more stands for all words never seen, dealt evenly to the 64-bit hashes, so the probabilities of all words add up to 1 too.
Counts of up to FREQUENT words go to every worker; the rest stay a distributed table, which rare words are joined with.

The network starts from the frequencies of the ids, so before any training it scores as they do, and is trained in numpy on
every word of every document in each round. Documents are turned into ids once and dealt by a hash of id and text to units
of about UNIT words, so a unit is the same whatever the files or tasks. In each round every unit starts from the last
round's network and goes once over its own words; networks and the optimizer's sums are averaged by words, as integers. So
the result depends neither on the order of tasks nor on how the input is split.

Edge cases: null, empty and blank texts have no words: log_prob 0, mean null; a text of any length is scored in one piece, and
one longer than a unit is a unit of its own; a word without neighbours is predicted from padding alone; words of equal
frequency have ids by their hash; repeated rows are trained on and scored as often as they come, and copies without an id
share a unit's key and fill as many units as they need; an empty table gives no rows, and the untrained network; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.arrow import pieces, utf8
from millrace.llm.native import quoted
from millrace.llm.shingles import mix, word_hashes
from millrace.session import discard, materialize

WINDOW = 2
CLASSES = MEMBERS = 64
DIM = 16
#: Passes over all documents; each masks every word in turn.
ROUNDS = 2
RATE = np.float32(0.12)
BATCH = 8192
#: Words that go through the network at once; their arrays stay in the CPU's cache.
CHUNK = 1024
PIECE = 1 << 20
#: Words of the documents that one network is trained on between averages.
UNIT = 1 << 22
#: Words of a unit whose neighbours are laid out at once.
LAID = 1 << 18
#: Ranges of parameters that are added up apart.
RANGES = 16
OWN = 2048
#: Words with counts that every worker holds, 16 bytes each.
FREQUENT = 1 << 18
#: Words that a task counts at once.
COUNTED = 1 << 22
#: Logarithms of counts are summed as integers, so the order of rows doesn't matter.
_FINE = 1 << 24
_SCALE = 1 << 16
#: Words that count as one when networks are averaged.
_WEIGHED = 1 << 10
_IDS = CLASSES * MEMBERS
_PLACES = [k for k in range(-WINDOW, WINDOW + 1) if k]
_NO_WORDS = np.empty(0, np.uint64)


@dataclass
class Vocabulary:
    """Counts of all words of a corpus, by their hashes."""

    #: word and n of the words that are not in `frequent`
    rest: DataFrame
    #: sorted hashes
    frequent: np.ndarray
    n: np.ndarray
    #: hashes of the words with an id of their own, a part of `frequent`, the most frequent first: their place is their id
    own: np.ndarray
    #: by id, the occurrences of the words that share it; 0 where it is a word's own
    totals: np.ndarray

    def per_id(self) -> np.ndarray:
        """The occurrences of every id."""
        out = self.totals.copy()
        out[: len(self.own)] += self.n[_found(self.own, self.frequent)[0]]
        return out


class Network:
    """Parameters as one vector with named views; id _IDS is padding, whose vector is trained too."""

    SHAPES = {
        "vectors": (_IDS + 1, DIM),
        "places": (len(_PLACES), DIM),
        "hidden_bias": (DIM,),
        "class_weights": (DIM, CLASSES),
        "class_bias": (CLASSES,),
        "class_vectors": (CLASSES, DIM),
        "member_weights": (DIM, MEMBERS),
        "member_bias": (MEMBERS,),
    }

    def __init__(self, flat: np.ndarray | None = None, counts: np.ndarray | None = None) -> None:
        """Without parameters, those of a network not trained yet. counts: the ids' occurrences, which it starts from."""
        sizes = {k: int(np.prod(s)) for k, s in self.SHAPES.items()}
        if flat is None:
            flat = np.random.default_rng(7).normal(0, 0.1, sum(sizes.values()))
            flat[sizes["vectors"] : sizes["vectors"] + sizes["places"]] = 1
        self.flat, at = flat.astype(np.float32), 0
        for name, n in sizes.items():
            setattr(self, name, self.flat[at : at + n].reshape(self.SHAPES[name]))
            at += n
        if counts is not None:
            n = (counts + 1.0).reshape(CLASSES, MEMBERS)
            self.hidden_bias[:] = 0
            self.class_bias[:] = np.log(n.sum(1) / n.sum())
            self.member_bias[:], self.class_vectors[:], self.member_weights[:] = _factored(np.log(n / n.sum(1, keepdims=True)))

    def _hidden(self, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors of all of a stretch, and the hidden layer of its words."""
        seen = self.vectors.take(padded, 0)
        total = np.zeros((len(padded) - 2 * WINDOW, DIM), np.float32)
        for k, place in zip(_PLACES, self.places, strict=True):
            total += seen[WINDOW + k : len(padded) - WINDOW + k] * place
        return seen, np.tanh(total.take(at - WINDOW, 0) + self.hidden_bias)

    def forward(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of each word's id from its neighbours. padded: ids in order, padding around every text; at: where the words are."""
        ids, hidden = padded[at], self._hidden(padded, at)[1]
        cls, member = ids // MEMBERS, ids % MEMBERS
        return _log_of(_logits(hidden, self.class_weights, self.class_bias), cls) + _log_of(_logits(hidden + self.class_vectors[cls], self.member_weights, self.member_bias), member)

    def gradient(self, padded: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Gradient of the mean negative log probability of the words."""
        g, scale = Network(np.zeros_like(self.flat)), np.float32(1 / len(at))
        ids = padded[at]
        cls, member = ids // MEMBERS, ids % MEMBERS
        seen, hidden = self._hidden(padded, at)
        d = np.empty_like(hidden)
        d_inner = np.empty_like(hidden)
        for i in range(0, len(at), CHUNK):
            part = slice(i, i + CHUNK)
            inner = hidden[part] + self.class_vectors[cls[part]]
            dc = _missed(_logits(hidden[part], self.class_weights, self.class_bias), cls[part], scale)
            dm = _missed(_logits(inner, self.member_weights, self.member_bias), member[part], scale)
            g.class_weights += (dc @ hidden[part]).T
            g.class_bias += dc.sum(1)
            g.member_weights += (dm @ inner).T
            g.member_bias += dm.sum(1)
            d_inner[part] = (self.member_weights @ dm).T
            d[part] = (self.class_weights @ dc).T + d_inner[part]
        d *= 1 - hidden * hidden
        g.class_vectors[:] = _summed(cls, d_inner, CLASSES)
        g.hidden_bias[:] = d.sum(0)
        # A word is the neighbour of those around it: what they ask of its vector is put together before it is summed by id.
        asked, of_word = np.zeros((len(padded) - 2 * WINDOW, DIM), np.float32), np.zeros_like(seen)
        asked[at - WINDOW] = d
        for j, k in enumerate(_PLACES):
            near = slice(WINDOW + k, len(padded) - WINDOW + k)
            of_word[near] += asked * self.places[j]
            g.places[j] = np.einsum("nd,nd->d", seen[near], asked)
        g.vectors[:] = _summed(padded, of_word, _IDS + 1)
        return g.flat


def _factored(table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean row, and a vector for each row and weights whose products are what the rows have beyond it, by as
    many directions as there are. Ids come by frequency, so few do."""
    left, scale, right = np.linalg.svd(table - table.mean(0), full_matrices=False)
    return table.mean(0), left[:, :DIM] * np.sqrt(scale[:DIM]), np.sqrt(scale[:DIM])[:, None] * right[:DIM]


def _logits(rows: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """A column per row, less its maximum: numpy goes along columns much faster."""
    x = weights.T @ rows.T
    x += bias[:, None]
    x -= x.max(0)
    return x


def _log_of(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = logits[at, np.arange(len(at))]
    return own - np.log(np.exp(logits, out=logits).sum(0))


def _missed(logits: np.ndarray, at: np.ndarray, scale: np.float32) -> np.ndarray:
    """Probabilities less 1 where the word is, times scale."""
    p = np.exp(logits, out=logits)
    p *= scale / p.sum(0)
    p[at, np.arange(len(at))] -= scale
    return p


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, column, n) for column in np.ascontiguousarray(rows.T)], 1)


def _found(h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each hash in the sorted words, and whether it is there."""
    if not len(words):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    return at, words[at] == h


def _shared(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    return len(own) + ((h >> np.uint64(33)) % np.uint64(_IDS - len(own))).astype(np.int64)


def _ids(h: np.ndarray, own: np.ndarray) -> np.ndarray:
    order = np.argsort(own)
    at, known = _found(h, own[order])
    return np.where(known, order[at] if len(own) else at, _shared(h, own))


def padded_ids(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids of texts of so many words in order, with padding before, between and after them, and where the words are."""
    out = np.full(len(ids) + WINDOW * (len(counts) + 1), _IDS, np.int64)
    at = np.arange(len(ids)) + WINDOW * (1 + np.repeat(np.arange(len(counts)), counts))
    out[at] = ids
    return out, at


def _stretches(padded: np.ndarray, at: np.ndarray, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The words in turn, so many at once, with their neighbours."""
    for i in range(0, len(at), words):
        part = at[i : i + words]
        low = part[0] - WINDOW
        yield padded[low : part[-1] + WINDOW + 1], part - low


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def summed() -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    held: list[np.ndarray] = []
    for batch in pieces(batches, limit=PIECE):
        held.append(word_hashes(*utf8(batch.column("text")))[0])
        if sum(map(len, held)) >= COUNTED:
            yield summed()
            held = []
    if held:
        yield summed()


def vocabulary(docs: DataFrame, text_col: str = "text", frequent: int = FREQUENT, own: int = OWN) -> Vocabulary:
    """Counts every word. The driver gets at most `frequent` of them, and sums of fixed number."""
    texts = docs.select(F.col(quoted(text_col)).alias("text"))
    counts = materialize(texts.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    levels = counts.groupBy(F.floor(8 * F.log2("n"))).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect()
    least, left = None, frequent
    for row in sorted(levels, key=lambda r: -r["least"]):
        left -= row["words"]
        if left < 0:
            break
        least = row["least"]
    often = F.lit(False) if least is None else F.col("n") >= least
    table = counts.where(often).toArrow()
    words, n = (table.column(k).to_numpy() for k in ("word", "n"))
    words = words.view(np.uint64)
    order = np.argsort(words)
    words, n = words[order], n[order]
    top = words[np.lexsort((words, -n))[:own]]
    shared = F.lit(len(top)) + F.shiftrightunsigned("word", 33) % (_IDS - len(top))
    totals = np.zeros(_IDS, np.int64)
    for row in counts.groupBy(shared.alias("id")).agg(F.sum("n").alias("n")).collect():
        totals[row["id"]] = row["n"]
    np.subtract.at(totals, _shared(top, top), n[_found(top, words)[0]])
    return Vocabulary(counts.where(~often), words, n, top, totals)


def _encoded(own):
    """deal, n_words and 16-bit ids of every document that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, limit=PIECE):
            h, counts = word_hashes(*utf8(batch.column("text")))
            ids, ends = _ids(h, own.value).astype("<u2"), np.cumsum(counts)
            parts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
            rows = pa.RecordBatch.from_arrays([batch.column("deal"), pa.array(parts, pa.binary())], ["deal", "ids"])
            yield rows.filter(pa.array(counts > 0))

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by unit: one row for the documents of a unit, or more where they have over UNIT words twice."""

    def out() -> pa.RecordBatch:
        counts = np.array([len(x) // 2 for x in held], "<i4")
        return pa.RecordBatch.from_arrays([pa.array([counts.tobytes()], pa.binary()), pa.array([b"".join(held)], pa.binary())], ["counts", "ids"])

    unit, held, words = None, [], 0
    for batch in batches:
        for k, ids in zip(batch.column("unit").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if held and (k != unit or words + len(ids) // 2 > 2 * UNIT):
                yield out()
                held, words = [], 0
            unit, words = k, words + len(ids) // 2
            held.append(ids)
    if held:
        yield out()


def dealt(docs: DataFrame, own: np.ndarray, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(counts, ids): a row for each unit. words: how many docs have in all."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.xxhash64(F.col(quoted(id_col)), F.col(quoted(text_col))).alias("deal"), F.col(quoted(text_col)).alias("text"))
    rows = rows.where("text IS NOT NULL").mapInArrow(_encoded(sc.broadcast(own)), "deal long, ids binary")
    units = max(1, round(words / UNIT))
    rows = rows.withColumn("unit", F.pmod("deal", F.lit(units)))
    return materialize(rows.repartition("unit").sortWithinPartitions("unit", "deal", "ids").mapInArrow(_units, "counts binary, ids binary"))


def learn_unit(flat: np.ndarray, power: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Network and optimizer's sums after one pass over the documents of a unit, every word masked once."""
    net, power, step = Network(flat.copy()), power.copy(), np.empty_like(flat)
    ends = np.cumsum(counts)
    cuts = np.flatnonzero(np.diff(ends // LAID)) + 1
    for part in np.split(np.arange(len(counts)), cuts):
        here = ids[ends[part[0]] - counts[part[0]] : ends[part[-1]]].astype(np.int64)
        for stretch in _stretches(*padded_ids(here, counts[part]), BATCH):
            g = net.gradient(*stretch)
            np.multiply(g, g, out=step)
            power += step
            np.sqrt(power, out=step)
            np.divide(g, step, out=step)
            step *= RATE
            net.flat -= step
    return net.flat, power


def _train(shared):
    """Sums of networks and of the roots of optimizers' sums, weighed by words, and of the weights, over the units of a task, in ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, power = shared.value
        total = np.zeros(2 * len(flat) + 1, np.int64)
        for batch in batches:
            for counts, ids in zip(batch.column("counts"), batch.column("ids"), strict=True):
                counts, ids = np.frombuffer(counts.as_buffer(), "<i4").astype(np.int64), np.frombuffer(ids.as_buffer(), "<u2")
                weight = -(-len(ids) // _WEIGHED)
                net, sums = learn_unit(flat, power, ids, counts)
                learned = np.concatenate([net.astype(np.float64) * _SCALE, np.sqrt(sums, dtype=np.float64) * _FINE])
                total[:-1] += np.rint(learned).astype(np.int64) * weight
                total[-1] += weight
        if total[-1]:
            for at, part in enumerate(np.array_split(total, RANGES)):
                yield _numbers(at, part)

    return run


def _numbers(at: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["at", "numbers"])


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for at, raw in zip(batch.column("at").to_pylist(), batch.column("numbers"), strict=True):
            total[at] = total.get(at, 0) + np.frombuffer(raw.as_buffer(), np.int64)
    for at, values in total.items():
        yield _numbers(at, values)


def train(docs: DataFrame, words: Vocabulary, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> np.ndarray:
    """Parameters, of a fixed number, after the given rounds over all documents. RANGES rows a round come to the driver."""
    sc, counts = docs.sparkSession.sparkContext, words.per_id()
    flat = Network(counts=counts).flat
    power = np.full(len(flat), 1e-6, np.float32)
    units = dealt(docs, words.own, int(counts.sum()), id_col, text_col)
    for _ in range(rounds):
        parts = units.mapInArrow(_train(sc.broadcast((flat, power))), "at int, numbers binary").repartition("at").mapInArrow(_summed_up, "at int, numbers binary")
        found = {r["at"]: np.frombuffer(bytes(r["numbers"]), np.int64) for r in parts.collect()}
        if not found:
            break
        total = np.concatenate([found[at] for at in range(RANGES)])
        net, sums = np.split(total[:-1] / total[-1], 2)
        flat, power = (net / _SCALE).astype(np.float32), np.square(sums / _FINE).astype(np.float32)
    discard(units)
    return flat


def _logs(net: Network, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.float32), *(net.forward(*x) for x in _stretches(*padded_ids(ids, counts), CHUNK))])


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    upto, ends = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)]), np.cumsum(counts)
    return upto[ends] - upto[ends - counts]


def score(docs: DataFrame, flat: np.ndarray, id_col: str = "doc_id", text_col: str = "text", words: Vocabulary | None = None) -> DataFrame:
    """id, n_words, log_prob (sum over all words) and mean_log_prob of every document. Without words, ids are scored alone."""
    sc, kind = docs.sparkSession.sparkContext, docs.schema[id_col].dataType.simpleString()
    shared = sc.broadcast(flat)
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"), F.monotonically_increasing_id().alias("node"))

    def by_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        for batch in pieces(batches, limit=PIECE):
            h, counts = word_hashes(*utf8(batch.column("text")))
            total = _sums(_logs(net, _ids(h, _NO_WORDS), counts), counts)
            mean = pa.array(total / np.maximum(counts, 1), mask=counts == 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts.astype(np.int64)), pa.array(total), mean], ["id", "n_words", "log_prob", "mean_log_prob"])

    if words is None:
        return rows.mapInArrow(by_id, f"id {kind}, n_words long, log_prob double, mean_log_prob double")

    # A row per document with all but the logarithms of rare words' counts, and a row for each of those words.
    names = ["node", "id", "n_words", "log_prob", "word"]
    own_id = np.full(len(words.frequent), -1, np.int64)
    own_id[_found(words.own, words.frequent)[0]] = np.arange(len(words.own))
    held = sc.broadcast((words.frequent, np.log(words.n), own_id, len(words.own), np.where(np.arange(_IDS) < len(words.own), 0, np.log(words.totals + 1.0))))

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(shared.value)
        frequent, log_n, own_id, own, log_total = held.value
        for batch in pieces(batches, limit=PIECE):
            h, counts = word_hashes(*utf8(batch.column("text")))
            each, inverse = np.unique(h, return_inverse=True)  # words are looked up once in a piece
            at, known = (x[inverse] for x in _found(each, frequent))
            ids = own + ((h >> np.uint64(33)) % np.uint64(_IDS - own)).astype(np.int64)
            if len(frequent):
                mine = own_id[at]
                ids = np.where(known & (mine >= 0), mine, ids)
            logs = _logs(net, ids, counts) - log_total[ids]
            add = known & (ids >= own)
            logs[add] += log_n[at[add]]
            node = batch.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("id"), pa.array(counts.astype(np.int64)), pa.array(_sums(logs, counts)), pa.array(mix(node.astype(np.uint64)).view(np.int64))], names)
            rare = pa.array(h[~known].view(np.int64))
            none = [pa.nulls(len(rare), t) for t in (batch.column("id").type, pa.int64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, counts)[~known]), *none, rare], names)

    parts = rows.mapInArrow(by_word, f"node long, id {kind}, n_words long, log_prob double, word long").join(words.rest, "word", "left")
    unseen = float((_IDS - len(words.own)) / 2**64)
    log_n = F.when(F.col("n_words").isNull(), F.round(F.log(F.coalesce(F.col("n").cast("double"), F.lit(unseen))) * _FINE).cast("long"))
    whole = parts.groupBy("node").agg(F.first("id", ignorenulls=True).alias("id"), F.max("n_words").alias("n_words"), F.max("log_prob").alias("log_prob"), F.coalesce(F.sum(log_n), F.lit(0)).alias("rare"))
    whole = whole.select("id", "n_words", (F.col("log_prob") + F.col("rare") / _FINE).alias("log_prob"))
    return whole.withColumn("mean_log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = vocabulary(docs)
    return score(docs, train(docs, words), words=words).withColumnRenamed("id", "doc_id")
