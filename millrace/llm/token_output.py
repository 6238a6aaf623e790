"""Token-ID output: texts are encoded and written, in ascending id order, as one wavelet matrix file per shard.

Documents are dealt by ranges of their id and sorted inside a range; every task writes files of at most SHARD_TOKENS tokens
(a longer document has a file of its own) to a folder that all executors reach, under a name of the attempt's own, so a task that is run again or
twice never touches another's file; the rows of the tasks that count name the files that count, and others are deleted.

The tokenizer's work on a word does not depend on its neighbours, so each worker keeps the ids of the words it has met, by
a 64-bit hash, and has its model encode new ones, letters and signs apart. A text is cut before white space that follows something else, which its pattern never joins; texts with runs of white space
are cut by a slower rule, with the same result.

Edge cases: a null text is empty, so its document has only the end id; repeated ids are kept, ordered by text; a null id
comes first; a text of any length is one document of one file; an empty table gives no file and no row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import wavelet
from millrace.llm.arrow import pieces, small_batches, utf8
from millrace.llm.shingles import mix, spans_hashed
from millrace.session import materialize, new_folder

END_ID = 2
#: Stands for a null id in a file.
NO_ID = -(1 << 63)
SHARD_TOKENS = 1 << 24
#: Words whose ids a worker keeps before it starts over.
KEPT = 2_000_000
#: Ids that it keeps before it starts over: words of any length have theirs there, until then.
KEPT_IDS = 1 << 24
#: Hashes that are held apart from the others, so that these are not moved for every piece.
RECENT = 1 << 16
#: Bytes of text that are encoded at once; the arrays about their words take many times that.
PIECE = 1 << 20
#: Bytes of a word that is looked up by its hash.
LONG = 48
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"[{_SPACE}]+[^{_SPACE}]*|[^{_SPACE}]+")
_ENCODERS: dict[str, Encoder] = {}


#: A word of letters, and signs of which the tokenizer's pattern makes one piece apart; both below U+0250, where Python's
#: letters are the pattern's.
_SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,!?;:#$%&*|]*)")


def _byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it prints, else one from U+0100 on, in order."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


_BYTES = str.maketrans({chr(b): c for b, c in enumerate(_byte_characters())})


#: Number of what stands where white space follows white space.
_UNSAFE = 0
#: Kinds of words, by what is before them: nothing, a new line or a space. Then signs after letters, and parts with white space.
_FIRST, _LINE, _LATER, _SIGNS, _PART = 0, 10, 32, 1, 2
#: Words that the tokenizer gets at once: what it returns takes far more than ids.
_AT_ONCE = 1 << 14


def _merged(known: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes, none of which is in both, and what belongs to them."""
    place = np.searchsorted(known[0], new[0])
    return np.insert(known[0], place, new[0]), np.insert(known[1], place, new[1])


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.reset()

    def reset(self) -> None:
        """Forgets all words. What is kept of one are numbers in arrays: its hash, where its ids are, and these; never its letters."""
        self.pool, self.used = np.empty(1 << 20, np.uint16), 0
        self.start, self.length, self.known = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64), 0
        #: hashes of words, sorted, and their numbers: of most, of the last ones, and those that this piece adds
        self.kept = self.recent = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.added: list[tuple[np.ndarray, np.ndarray]] = []
        self._add([0], np.empty(0, np.uint16))  # _UNSAFE
        self.line = self._add_lists(self._encode(["\n"])).item()

    def _pieces(self, texts: list[str], lead: str) -> list[list[int]]:
        """Ids of texts of letters, each of which the tokenizer's pattern takes as one piece, after the same lead."""
        spelt = "\n".join(texts).encode().decode("latin-1").translate(_BYTES).split(_BYTES[ord("\n")]) if texts else []
        lead = lead.translate(_BYTES)
        return [[t.id for t in self.model.tokenize(lead + x)] for x in spelt]

    def _encode(self, texts: list[str], lead: str = "") -> list[list[int]]:
        """Ids of any texts, by the tokenizer itself."""
        return [e.ids for e in self.tokenizer.encode_batch_fast([lead + x for x in texts], add_special_tokens=False)]

    def _add(self, lengths: np.ndarray | list[int], ids: np.ndarray) -> np.ndarray:
        """Numbers of new words, whose ids stand one after another."""
        n, total = len(lengths), len(ids)
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while self.known + n > len(self.start):
            self.start, self.length = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length))
        self.pool[self.used : self.used + total] = ids
        self.length[self.known : self.known + n] = lengths
        self.start[self.known : self.known + n] = self.used + np.cumsum(lengths) - lengths
        self.used, self.known = self.used + total, self.known + n
        return np.arange(self.known - n, self.known)

    def _add_lists(self, ids: list[list[int]]) -> np.ndarray:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return self._add(lengths, np.fromiter(chain.from_iterable(ids), np.uint16, int(lengths.sum())))

    def _add_pairs(self, a: list[int], b: list[int]) -> np.ndarray:
        """Words whose ids are those of two known ones."""
        both = np.array([a, b], np.int64).reshape(2, -1).T.ravel()
        return self._add(self.length[both].reshape(-1, 2).sum(1), self._ids_of(both))

    def _ids_of(self, numbers: np.ndarray) -> np.ndarray:
        lengths = self.length[numbers]
        ahead = np.cumsum(lengths) - lengths
        return self.pool[np.repeat(self.start[numbers] - ahead, lengths) + np.arange(int(lengths.sum()))]

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes; -1 for new ones."""
        found = np.full(len(keys), -1)
        for known, number_of in (self.kept, self.recent):
            if len(known):
                place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                found = np.where(known[place] == keys, number_of[place], found)
        return found

    def _keep(self) -> None:
        """Puts what the piece has added among the known hashes; most of them are moved only now and then."""
        keys, numbers = (np.concatenate(x) for x in zip(*self.added, strict=True))
        keys, first = np.unique(keys, return_index=True)
        self.added, self.recent = [], _merged(self.recent, (keys, numbers[first]))
        if len(self.recent[0]) > RECENT:
            self.kept, self.recent = _merged(self.kept, self.recent), (keys[:0], numbers[:0])

    def _get(self, words: list[str], kind: int, ids: Callable[[list[str]], list[list[int]]]) -> dict[str, int]:
        """Numbers of words, all different; ids gives the ids of new ones."""
        coded = [w.encode() for w in words]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        stops = np.cumsum(sizes)
        keys = spans_hashed(np.frombuffer(b"".join(coded), np.uint8), stops - sizes, stops) ^ mix(np.uint64([kind + 1]))
        numbers = np.where(sizes > LONG, -1, self._look_up(keys))
        new = np.flatnonzero(numbers < 0)
        for i in range(0, len(new), _AT_ONCE):
            part = new[i : i + _AT_ONCE]
            numbers[part] = self._add_lists(ids([words[k] for k in part.tolist()]))
        new = new[sizes[new] <= LONG]
        self.added.append((keys[new], numbers[new]))
        return dict(zip(words, numbers.tolist(), strict=True))

    def _learn(self, words: list[str], kind: int) -> list[int]:
        """Numbers for new words of one kind."""
        if kind == _LINE:
            lines = [w for w in words if w[0] not in _SPACE]
            first = self._get_words(lines, _FIRST)
            found = dict(zip(lines, self._add_pairs([self.line] * len(lines), [first[w] for w in lines]).tolist(), strict=True))
        else:
            found = self._get_words([w for w in words if kind == _FIRST or w[0] not in _SPACE], kind)
        return [found.get(w, _UNSAFE) for w in words]

    def _get_words(self, words: list[str], kind: int) -> dict[str, int]:
        """Letters are a piece for the tokenizer's pattern, and so are the signs after them: both are encoded apart, and words
        with signs are put together of them."""
        lead = " " if kind == _LATER else ""
        letters, signed, other = {}, [], []
        for word in dict.fromkeys(words):
            if simple := _SIMPLE.fullmatch(word):
                letters[simple[1]] = None
                if simple[2]:
                    signed.append((word, simple[1], simple[2]))
            else:
                other.append(word)
        found = self._get(list(letters), kind, lambda new: self._pieces(new, lead))
        signs = self._get(list({x[2]: None for x in signed}), _SIGNS, self._encode)
        pairs = self._add_pairs([found[x[1]] for x in signed], [signs[x[2]] for x in signed])
        return found | dict(zip((x[0] for x in signed), pairs.tolist(), strict=True)) | self._get(other, kind, lambda new: self._encode(new, lead))

    def _numbers(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, and how many each text has.

        Words go by a 64-bit hash of their bytes and of what stands before them, so only those that are new ever become
        strings. A word of over LONG bytes has its place for a hash, so it is never taken for another.
        """
        n = len(ends) - 1
        text_at = ends[:-1] + np.arange(n)  # of the separator before each text
        bytes_ = np.insert(raw, ends, 32)
        apart = (bytes_ == 32) | (bytes_ == 10)
        edge = np.flatnonzero(apart[1:] != apart[:-1]) + 1
        starts, stops = edge[::2], edge[1::2]
        before = bytes_[starts - 1].astype(np.uint64)
        bounds = np.searchsorted(starts, np.append(text_at + 1, len(bytes_)))
        sizes = np.diff(bounds)
        heads = np.flatnonzero(np.isin(starts, text_at + 1))
        before[heads] = 0
        long = np.flatnonzero(stops - starts > LONG)
        keys = spans_hashed(bytes_, starts, stops) ^ mix(before + np.uint64(1))
        keys[long] = mix(starts[long].astype(np.uint64) + np.uint64(1 << 40))
        new_key, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        number = self._look_up(new_key)
        fresh = np.flatnonzero(number < 0)
        fresh_kind = before[first[fresh]]
        for kind in (_FIRST, _LATER, _LINE):
            own = fresh[fresh_kind == kind]
            spans = zip(starts[first[own]].tolist(), stops[first[own]].tolist(), strict=True)
            number[own] = self._learn([bytes_[i:j].tobytes().decode() for i, j in spans], kind)
        fresh = fresh[~np.isin(new_key[fresh], keys[long])]
        self.added.append((new_key[fresh], number[fresh]))
        numbers = number[inverse]
        # White space beside white space, or at a text's end, is cut by a slower rule.
        real = apart.copy()
        real[text_at] = real[-1] = False
        pairs = np.flatnonzero(real[:-1] & apart[1:])
        unsafe = np.union1d(np.searchsorted(text_at, pairs, side="right") - 1, np.repeat(np.arange(n), sizes)[numbers == _UNSAFE]).astype(np.int64)
        if len(unsafe):
            cut = [_RUNS.findall(raw[ends[i] : ends[i + 1]].tobytes().decode()) for i in unsafe.tolist()]
            found = self._get(list(dict.fromkeys(chain.from_iterable(cut))), _PART, self._encode)
            per = np.split(numbers, bounds[1:-1])
            for i, parts in zip(unsafe.tolist(), cut, strict=True):
                per[i] = np.fromiter(map(found.__getitem__, parts), np.int64, len(parts))
            numbers, sizes = np.concatenate(per), np.array(list(map(len, per)), np.int64)
        self._keep()
        return numbers, sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by END_ID, and the number of ids of each."""
        if self.known > KEPT or self.used > KEPT_IDS:
            self.reset()
        at, sizes = self._numbers(*utf8(texts))
        lengths = self.length[at]
        per_text = np.add.reduceat(np.append(lengths, 0), np.minimum(np.cumsum(sizes) - sizes, len(lengths))) * (sizes > 0) if len(sizes) else sizes
        return np.insert(self._ids_of(at), np.cumsum(per_text), np.uint16(END_ID)), per_text + 1


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _store(uri: str):
    """The file system of a URI of Spark's, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(portable(uri))


def portable(uri: str) -> str:
    """Schemes that only Hadoop has for a store that others name too."""
    scheme, apart, rest = uri.partition("://")
    return {"s3a": "s3", "s3n": "s3", "wasbs": "abfss"}.get(scheme, scheme) + apart + rest


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the shards; one row per file: part, seq, path, n_docs, n_tokens. docs' ids are integers."""
    store, path = _store(folder)
    store.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, attempt = encoder(tokenizer), TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        held, seq = [], 0

        def flush() -> pa.RecordBatch:
            ids, tokens, sizes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            name = f"{folder}/shard-{part:06d}-{seq:04d}-{attempt}.wm"
            store, path = _store(name)
            with store.open_output_stream(path) as out:
                wavelet.write(out, tokens, ids, np.cumsum(sizes))
            values = ([part], [seq], [name], [len(ids)], [len(tokens)])
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "path", "n_docs", "n_tokens"])

        for batch in pieces(batches, limit=PIECE):
            ids = batch.column("id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            tokens, sizes = encode.encode(batch.column("text"))
            if held and sum(len(h[1]) for h in held) + len(tokens) > SHARD_TOKENS:
                yield flush()
                seq += 1
            held.append((ids, tokens, sizes))
        if held:
            yield flush()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ordered = slim.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    with small_batches(docs.sparkSession):
        shards = materialize(ordered.mapInArrow(run, "part int, seq int, path string, n_docs long, n_tokens long"))
    _clear(folder, shards)
    return shards


def _clear(folder: str, shards: DataFrame) -> None:
    """Deletes what attempts of tasks have left that were lost or came second. One name per file comes to the driver."""
    from pyarrow import fs

    store, path = _store(folder)
    named = {r["path"].rpartition("/")[2] for r in shards.select("path").toLocalIterator()}
    for file in store.get_file_info(fs.FileSelector(path)):
        if file.base_name.endswith(".wm") and file.base_name not in named:
            store.delete_file(file.path)


def read(shards: DataFrame) -> DataFrame:
    """id, start, n_tokens, ids_crc32 of every document, from the files alone. One row per shard comes in."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                store, at = _store(path)
                with store.open_input_file(at) as file:
                    shard = wavelet.Reader(file)
                    tokens = shard.tokens()
                ends = np.asarray(shard.ends)
                starts = ends - np.diff(ends, prepend=0)
                raw = memoryview(tokens.astype("<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID), pa.array(starts + start), pa.array(ends - starts), pa.array(crcs, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    # By number, since the planner would put the few rows into one task.
    return placed.repartition(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def op5_token_output(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    folder = new_folder(spark, "tokens")
    shards = write(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, tokenizer)
    return read(shards).withColumnRenamed("id", "doc_id")
