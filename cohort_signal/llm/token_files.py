"""Token-ID output as Arrow IPC files of fixed-size-list batches.

The ids of all documents, in ascending doc_id order and each ended by END_ID,
form one stream that is cut into sequences of SEQUENCE ids.  A file holds the
sequences of one doc_id range: record batches of two fixed-size-list columns,
``ids`` and ``mask`` (true: an id, false: padding behind the file's last id).  Every
sequence has the same length, so sequence k of a file is found by arithmetic
and is read without copying from a memory map.  Beside it an index file gives
each document's first id and number of ids within the file (an end id can also
occur inside a text, so the stream alone does not show the borders).

Scale: documents are range-partitioned by id (one shuffle, spilled sort);
a task streams its range into its files and holds one slice of rows and one
batch of sequences.  Only the manifest (one row per file) is gathered, to turn
file-local into global positions.  A task that is run again writes files of
another name, and the manifest names those of the attempt that ended, so lost
executors leave at most unused files behind.

Edge cases: null texts are empty and get the end id alone; rows with a null id
are left out; rows that repeat an id are separate documents, ordered by text;
an empty table gives no files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_signal.session import scratch_path

from .common import materialise, only, ship, slices

SEQUENCE = 2048
END_ID = 2
#: Sequences of one record batch (4 MB of 16-bit ids).
BATCH_SEQUENCES = 1024
#: Rows that are encoded together.
ROWS = 2048
#: Pieces a worker keeps with their ids before it starts anew (about 80 MB).
CACHE_LIMIT = 500_000
#: Texts of one call of the tokenizer, whose result takes about 150 bytes a token.
CALL = 100
#: Words encoded in one call, parted by spaces.
JOINED = 100

#: Characters whose lower case depends on their place or has more than one
#: letter, white space to Python that tokenizers keep as text, and the start of
#: the special tokens' names: texts that hold one are encoded whole.
_WHOLE = ("\u03a3", "\u0130", "\x1c", "\x1d", "\x1e", "\x1f", "<|")
_CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Above it letters are not parted from closing marks.
_LAST_LETTER = "\u0590"
#: Fixed value: words, digits and runs of other marks, as the public file states them.
_PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def encodes_by_piece(path: str) -> bool:
    """Whether a tokenizer file states that texts are brought to NFC and lower
    case, that white space parts them and is dropped, and that letters, digits
    and other marks never share a token that ends a word."""
    with open(path, encoding="utf-8") as f:
        stated = json.load(f)
    kinds = [n.get("type") for n in (stated.get("normalizer") or {}).get("normalizers", [])]
    first = ((stated.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (kinds == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and first.get("pattern") == {"Regex": _PIECE_PATTERN}
            and first.get("behavior") == "Removed" and first.get("invert") is True and stated["model"].get("end_of_word_suffix") == "</w>"
            and all(t["content"].startswith("<|") for t in stated.get("added_tokens", [])))


class Encoder:
    """Encodes whole texts with a tokenizer file of the ``tokenizers`` library.

    For a tokenizer of the kind of ``encodes_by_piece`` a text's ids are those
    of its white-space separated pieces in order, and those of a piece that
    ends in marks behind a letter or digit are those of both parts.  The texts
    of a slice are split and their distinct pieces found by Arrow; each
    distinct piece is encoded once and remembered by number; ids are gathered
    by number.  Words are encoded many at a time and parted at the ids that
    end a word.  Other texts (``_WHOLE``, not in NFC) are encoded whole."""

    def __init__(self, path: str, by_piece: bool) -> None:
        # a task is one thread
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.by_piece = by_piece
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {"": 0}
        self.ids = np.zeros(0, self.width)
        #: first byte of each piece's ids, and the end of the last
        self.borders = np.zeros(2, np.int64)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, self.width) for at in range(0, len(texts), CALL)
                for e in self.tokenizer.encode_batch_fast(texts[at:at + CALL], add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> None:
        words = [p for p in pieces if p.isalpha()]
        others = [p for p in pieces if not p.isalpha()]
        groups = [words[at:at + JOINED] for at in range(0, len(words), JOINED)]
        ids, sizes = [], []
        for group, together in zip(groups, self._each([" ".join(g) for g in groups])):
            cuts = np.flatnonzero(self.ends[together]) + 1
            if len(cuts) == len(group):
                ids.append(together)
                sizes.append(np.diff(cuts, prepend=0))
            else:
                apart = self._each(group)
                ids += apart
                sizes.append(np.array([len(a) for a in apart], np.int64))
        apart = self._each(others)
        ids += apart
        sizes.append(np.array([len(a) for a in apart], np.int64))
        self.numbers.update(zip(words + others, range(len(self.numbers), len(self.numbers) + len(pieces))))
        self.borders = np.concatenate([self.borders, self.borders[-1] + np.cumsum(np.concatenate(sizes)) * self.width.itemsize])
        self.ids = np.concatenate([self.ids, *ids])

    def _known(self) -> pa.LargeBinaryArray:
        """The ids of all remembered pieces by number."""
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.numbers), [None, pa.py_buffer(self.borders), pa.py_buffer(self.ids)])

    @staticmethod
    def _part(piece: str) -> tuple[str, str]:
        """(piece without closing marks, closing marks), or (piece, "")."""
        stem = piece.rstrip(_CLOSING)
        if len(stem) == len(piece) or not stem:
            return piece, ""
        last = stem[-1]
        return (stem, piece[len(stem):]) if "0" <= last <= "9" or (last < _LAST_LETTER and last.isalpha()) else (piece, "")

    def _by_piece(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lower-cased texts in NFC -> (ids of all, number of ids of each)."""
        split = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        pieces = split.flatten().dictionary_encode()
        parts = [(p, "") if p[-1:].isalpha() else self._part(p) for p in pieces.dictionary.to_pylist()]
        if len(self.numbers) > CACHE_LIMIT:
            self._forget()
        missing = {p for both in parts for p in both}.difference(self.numbers)
        if missing:
            self._learn(list(missing))
        number, known = self.numbers, self._known()
        front, back = (known.take(pa.array([number[p[side]] for p in parts], pa.int64())) for side in (0, 1))
        in_order = pc.binary_join_element_wise(front, back, pa.scalar(b"", pa.large_binary())).take(pieces.indices)
        borders = np.frombuffer(in_order.buffers()[1], np.int64, len(in_order) + 1)
        ids = np.frombuffer(in_order.buffers()[2] or b"", self.width, borders[-1] // self.width.itemsize)
        return ids, np.diff(borders[split.offsets.to_numpy()]) // self.width.itemsize

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, of self.width; number of ids of each)."""
        lower = [t.lower() for t in texts]
        fast = [self.by_piece and not any(w in t for w in _WHOLE) and (t.isascii() or (is_normalized("NFC", t) and is_normalized("NFC", low)))
                for t, low in zip(texts, lower)]
        if texts and all(fast):
            return self._by_piece(lower)
        sizes = np.zeros(len(texts), np.int64)
        rest = iter(self._each([t for t, f in zip(texts, fast) if not f]))
        some = np.array(fast, bool)
        ids, sizes[some] = self._by_piece([t for t, f in zip(lower, fast) if f])
        parts = iter(np.split(ids, np.cumsum(sizes[some])[:-1]) if some.any() else [])
        found = [next(parts) if f else next(rest) for f in fast]
        return np.concatenate([np.zeros(0, self.width), *found]), np.array([len(f) for f in found], np.int64)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_piece: bool) -> Encoder:
    """One per worker process."""
    only("encoders", _ENCODERS.clear)
    key = (path, by_piece)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, by_piece)
    return _ENCODERS[key]


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + re.sub("^file:", "", uri))


def _sequence_schema(width: np.dtype, sequence: int) -> pa.Schema:
    ids = pa.uint16() if width.itemsize == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(ids, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])


class _SequenceFile:
    """Cuts a stream of ids into record batches of one Arrow file."""

    def __init__(self, fs: pafs.FileSystem, path: str, width: np.dtype, sequence: int) -> None:
        self.schema, self.width, self.sequence = _sequence_schema(width, sequence), width, sequence
        self.sink = fs.open_output_stream(path)
        # no compression, so that reads need no copy
        self.writer = pa.ipc.new_file(self.sink, self.schema, metadata={"sequence": str(sequence)})
        self.waiting: list[bytes] = []
        self.size = 0

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        self.writer.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(ids), self.sequence),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.sequence)], schema=self.schema))

    def add(self, data: bytes) -> None:
        self.waiting.append(data)
        self.size += len(data)
        room = BATCH_SEQUENCES * self.sequence * self.width.itemsize
        if self.size >= room:
            whole = b"".join(self.waiting)
            for at in range(0, len(whole) - room + 1, room):
                self._batch(np.frombuffer(whole, self.width, room // self.width.itemsize, at), room)
            self.waiting = [whole[len(whole) // room * room:]]
            self.size = len(self.waiting[0])

    def close(self) -> None:
        ids = np.frombuffer(b"".join(self.waiting), self.width)
        if len(ids):
            padded = np.zeros(-(-len(ids) // self.sequence) * self.sequence, self.width)
            padded[:len(ids)] = ids
            self._batch(padded, len(ids))
        self.writer.close()
        self.sink.close()


_MANIFEST = "first_id long, last_id long, path string, n_docs long, n_tokens long"


def _write(folder: str, vocab: str, by_piece: bool, sequence: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = f"{base}/{uuid.uuid4().hex}"
        enc = encoder(vocab, by_piece)
        out = index = index_sink = None
        first = last = None
        docs = tokens = 0
        for batch in slices(batches, ROWS):
            ids = batch.column("doc_id").to_pylist()
            if ids:
                if out is None:
                    out = _SequenceFile(fs, name + ".arrow", enc.width, sequence)
                    index_sink = fs.open_output_stream(name + ".index.arrow")
                    index = pa.ipc.new_file(index_sink, pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())]))
                data, n = enc.encode([t or "" for t in batch.column("text").to_pylist()])
                out.add(np.insert(data, np.cumsum(n), END_ID).tobytes())
                n = n + 1
                index.write_batch(pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(tokens + np.cumsum(n) - n), "n_tokens": pa.array(n)}))
                first, last = ids[0] if first is None else first, ids[-1]
                docs, tokens = docs + len(ids), tokens + int(n.sum())
        if out is not None:
            out.close()
            index.close()
            index_sink.close()
            yield pa.record_batch({"first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "path": [name],
                                   "n_docs": pa.array([docs], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    return run


def write_token_files(docs: DataFrame, vocab: str, folder: str | None = None, by_piece: bool | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Write the files and return their manifest, one row per file in doc_id
    order: path (without the ending .arrow / .index.arrow), first_id, last_id,
    n_docs, n_tokens and start (ids of all files before it).

    ``folder`` defaults to a new one under the session's checkpoint folder;
    any URI of a file system that pyarrow knows will do.  ``by_piece`` is read
    from the tokenizer file unless given."""
    spark = docs.sparkSession
    ship(spark)
    by_piece = encodes_by_piece(vocab) if by_piece is None else by_piece
    folder = folder or scratch_path(spark, "tokens")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    ranged = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialise(ranged.mapInArrow(_write(folder, vocab, by_piece, sequence), _MANIFEST), "token_manifest")
    rows = manifest.toArrow().sort_by([("first_id", "ascending"), ("last_id", "ascending")]).to_pylist()
    start = 0
    for r in rows:
        r["start"] = start
        start += r["n_tokens"]
    schema = "first_id long, last_id long, path string, n_docs long, n_tokens long, start long"
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame([tuple(r[c] for c in ("first_id", "last_id", "path", "n_docs", "n_tokens", "start")) for r in rows], schema)


def open_sequences(path: str, folder: str | None = None) -> pa.ipc.RecordBatchFileReader:
    """A file's reader; memory-mapped (no copies) where the file is local."""
    fs, p = _filesystem(folder or path)
    p = f"{p}/{path.rpartition('/')[2]}" if folder else p
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(p))
    return pa.ipc.open_file(fs.open_input_file(p))


class SequenceReader:
    """Random access to the sequences and id ranges of one file."""

    def __init__(self, reader: pa.ipc.RecordBatchFileReader, sequence: int = SEQUENCE) -> None:
        self.reader, self.sequence, self.at, self.held = reader, sequence, -1, (np.zeros(0), np.zeros(0, bool))

    def _flat(self, batch: int) -> tuple[np.ndarray, np.ndarray]:
        if batch != self.at:
            b = self.reader.get_batch(batch)
            self.held = np.asarray(b.column(0).flatten()), b.column(1).flatten().to_numpy(zero_copy_only=False)
            self.at = batch
        return self.held

    def sequence_at(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of the file's sequence k."""
        ids, mask = self._flat(k // BATCH_SEQUENCES)
        lo = k % BATCH_SEQUENCES * self.sequence
        return ids[lo:lo + self.sequence], mask[lo:lo + self.sequence]

    def parts(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids [start, start + n) of the file, masked ones left out, in
        parts of at most one record batch."""
        step = BATCH_SEQUENCES * self.sequence
        while n > 0:
            ids, mask = self._flat(start // step)
            lo = start % step
            hi = min(lo + n, len(ids))
            yield ids[lo:hi] if mask[lo:hi].all() else ids[lo:hi][mask[lo:hi]]
            n -= hi - lo
            start += hi - lo


def _digest(folder: str, sequence: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                reader = SequenceReader(open_sequences(path + ".arrow", folder), sequence)
                index = open_sequences(path + ".index.arrow", folder)
                for k in range(index.num_record_batches):
                    part = index.get_batch(k)
                    counts, crcs = [], []
                    for start, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist()):
                        crc = count = 0
                        for ids in reader.parts(start, n):
                            crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                            count += len(ids)
                        counts.append(count)
                        crcs.append(crc)
                    yield pa.record_batch({
                        "doc_id": part.column("doc_id"), "start": pa.array(part.column("start").to_numpy() + base),
                        "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return run


def read_digests(manifest: DataFrame, folder: str, sequence: int = SEQUENCE) -> DataFrame:
    """Read the files back, one task per file at most: doc_id, start,
    n_tokens and ids_crc32 (of the ids as little-endian 32-bit integers)."""
    spark = manifest.sparkSession
    ship(spark)
    files = max(1, manifest.count())
    return (manifest.select("path", "start").repartition(files, "path")
            .mapInArrow(_digest(folder, sequence), "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_files_with_digests(docs: DataFrame, vocab: str, folder: str | None = None) -> DataFrame:
    """Write the files of ``docs`` and return the digests read from them."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    return read_digests(write_token_files(docs, vocab, folder), folder)


def describe(manifest: DataFrame) -> str:
    """The manifest as JSON lines, to be kept beside the files."""
    return "\n".join(json.dumps(r.asDict()) for r in manifest.orderBy("start").toLocalIterator())
