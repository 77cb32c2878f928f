"""SentencePiece encoding and decoding over a relational lattice.

Text is encoded with the pieces and scores of a public piece model: spaces become marks, a mark
is put in front, and the segmentation with the highest sum of scores (fixed-point, of 2 ** -14) is taken. No piece has a mark
behind another character, so every mark begins a part that is segmented by itself; line ends are
in no longer piece, so they are parts too; a part is cut behind its leading letters where no
piece has the two characters side by side. The distinct parts of the whole corpus are exploded
into their substrings of bounded length, equi-joined with the piece table, grouped by part as the
edges of a lattice, and folded over their positions by a higher-order aggregate, which keeps the
best score of each position and the piece that ends there (of equal scores the longest). A
character that no piece covers costs UNKNOWN and becomes its bytes' pieces.

A part of more than LONG characters is known by its hash and travels in chunks of CHUNK starting
places, which are exploded and joined by themselves; its edges are grouped by the place they end at, places
by chunk, chunks by part, and the fold goes from chunk to chunk with the last scores alone, so work is linear
in the part's length.

Documents are dealt by a hash to buckets of about BUCKET bytes of text; what is moved are compressed
blocks of them. A bucket's distinct parts meet their segmentations where the corpus's parts are, and come
back with them to put the bucket's documents together. A task holds the segmentations of one bucket and
one block of documents at a time.

Cases: a null or empty text has no ids and decodes to empty text; parts longer than LONG are cut
before and after characters that are in no longer piece, and are else folded whole, however long
(the edges of a part must fit one row of Spark, which is some ten million characters without a space); a mark in
the text itself decodes to a space, as in the model; repeated rows are encoded each; an empty
table gives no rows; other columns of the input don't matter.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, partitions, slices
from .vocabulary import MARK, default_piece_model, pieces

#: Penalty of a character without a piece, and the least score of a piece.
UNKNOWN = -1e6
LONG = 64
#: Characters that stand for the lengths 1, 2, ... of pieces.
LENGTHS = "0123456789abcdefghijklmnopqrstu"
# An edge's bits: 22 for its end, 36 for its weight, a fixed-point score above _ZERO, 5 for its length.
_KBITS, _WBITS, _FRACTION = 5, 36, 14
_ZERO = 1 << (_WBITS - 1)
#: Starting places of a chunk of a long part; its row has a key of KEY characters, 8 of the chunk's number and its text.
CHUNK = 1024
KEY = 65
#: Rows are packed into blocks in slices of about so many bytes.
PACKED = 16 << 20
#: Bytes of text of a bucket, and atoms that are sent or looked up together.
BUCKET = 32 << 20
TOGETHER = 50_000
#: Texts are cut, looked up and put together in slices of about so many bytes.
SLICE = 2 << 20
_BLOCKS = "bucket int, block binary"
_PARTS = "bucket int, part string"


def _weight(score: float) -> int:
    return round(max(score, UNKNOWN) * (1 << _FRACTION))


def piece_table(path: str) -> list[tuple[str, int, float]]:
    """piece, piece_id, score of the pieces that take part in lattices."""
    return [(name, i, float(score)) for i, (name, score) in enumerate(pieces(path)) if name]


_LEADING = re.compile(f"{MARK}?[^\\W\\d_]+")


class Splitter:
    """The parts of texts, which joined are the marked text, and the atoms of parts."""

    def __init__(self, names: list[str]) -> None:
        self._joined = {name[i : i + 2] for name in names for i in range(len(name) - 1)}
        inside = sorted({ord(ch) for name in names if len(name) > 1 for ch in name})
        self._cut = re.compile("([^%s])" % "".join(f"\\U{c:08x}" for c in inside)) if inside else re.compile("(.)", re.S)

    def parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "\0" in text:
            return [p for p in re.split(f"(?={MARK})|(\n)", MARK + text.replace(" ", MARK)) if p]
        return (MARK + text.replace(" ", "\0" + MARK).replace("\n", "\0\n\0")).split("\0")

    def atoms(self, part: str) -> list[str]:
        """What a part is made of: cut behind its leading letters if no piece has the two characters there side by side.

        Parts longer than LONG are cut before and after characters that are in no longer piece.
        """
        if part[1:].isalpha() and len(part) <= LONG:
            return [part]
        if len(part) > LONG:
            return [p for p in self._cut.split(part) if p]
        found = _LEADING.match(part)
        cut = found.end() if found else 0
        return [part[:cut], part[cut:]] if 0 < cut < len(part) and part[cut - 1 : cut + 1] not in self._joined else [part]

    def parts_of(self, texts: pa.StringArray) -> tuple[pa.Array, np.ndarray]:
        """parts() of many texts, one after the other, and how many each has."""
        full = pc.greater(pc.binary_length(texts), 0).fill_null(False)
        some, counts = texts.filter(full), np.zeros(len(texts), np.int64)
        if pc.any(pc.match_substring(some, "\0")).as_py():
            lists = pa.array([self.parts(t) for t in some.to_pylist()], pa.list_(pa.string()))
        else:
            marked = pc.replace_substring(pc.replace_substring(some, " ", "\0" + MARK), "\n", "\0\n\0")
            lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar(MARK), marked, ""), "\0")
        counts[full.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
        return lists.flatten(), counts

    def cut(self, parts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The atoms of many parts, one after the other, and how many each has; empty parts have none."""
        whole = pc.and_(pc.utf8_is_alpha(pc.utf8_slice_codeunits(parts, 1)), pc.less_equal(pc.utf8_length(parts), LONG)).to_numpy(zero_copy_only=False)
        rest = [self.atoms(p) if p else [] for p in parts.filter(pa.array(~whole)).to_pylist()]
        counts, begin = np.ones(len(parts), np.int64), np.zeros(len(parts), np.int64)
        counts[~whole] = [len(x) for x in rest]
        n = int(whole.sum())
        begin[whole], begin[~whole] = np.arange(n), n + np.cumsum(counts[~whole]) - counts[~whole]
        both = pa.concat_arrays([parts.filter(pa.array(whole)), pa.array([a for x in rest for a in x], pa.string())])
        return both.take(pa.array(spread(begin, counts))), counts


def spread(begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, counts of them, one run after the other."""
    shift = (begin - (np.cumsum(counts) - counts)).astype(np.int32)
    out = np.repeat(shift, counts)
    out += np.arange(len(out), dtype=np.int32)
    return out


def _splitter(names: list[str]) -> Splitter:
    splitters, key = kept("pieces"), hash(tuple(names))
    if key not in splitters:
        splitters.clear()
        splitters[key] = Splitter(names)
    return splitters[key]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each bucket as compressed Arrow streams."""
    kept("pieces")
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))
    for batch in slices(batches, most=PACKED):
        ordered = batch.take(pc.sort_indices(batch.column("bucket")))
        bucket = ordered.column("bucket").to_numpy()
        ends = np.append(np.nonzero(np.diff(bucket))[0] + 1, len(bucket))
        begin, blocks = 0, []
        rows = ordered.select(["doc_id", "text"])
        for end in ends.tolist():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as out:
                out.write_batch(rows.slice(begin, end - begin))
            blocks.append((int(bucket[begin]), sink.getvalue().to_pybytes()))
            begin = end
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), pa.array([x for _, x in blocks], pa.binary())], ["bucket", "block"])


def _unpack(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks:
        for block in batch.column("block"):
            if block.is_valid:
                yield from pa.ipc.open_stream(block.as_buffer())


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The batches' rows in batches of about ``most`` bytes of text, small ones together, large ones cut."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in slices([batch], most=most):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + n > most:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield pa.concat_batches(held)


def _trim() -> None:
    """Give unused memory back, so that a worker between two groups holds little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _key(atom: str) -> str:
    """What stands for an atom of more than LONG characters; no other row's part begins with it."""
    return "\0" + hashlib.sha256(atom.encode("utf-8", "surrogatepass")).hexdigest()


def _chunks(atom: str, longest: int) -> list[str]:
    """Key, number and text of each chunk: CHUNK starting places and what a piece can reach from them."""
    key = _key(atom)
    return [f"{key}{i:08x}{atom[i * CHUNK : (i + 1) * CHUNK + longest - 1]}" for i in range(-(-len(atom) // CHUNK))]


def _atoms_of(names: list[str], longest: int):
    """The bucket's distinct atoms, long ones as chunks."""

    def run(key: tuple[pa.Scalar, ...], blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = _splitter(names)
        seen: list[pa.Array] = []
        for batch in _gathered(_unpack(blocks), SLICE):
            seen.append(splitter.parts_of(batch.column("text"))[0].unique())
        parts = pa.chunked_array(seen, pa.string()).unique()
        del seen
        atoms = splitter.cut(parts)[0].unique()
        del parts
        longer = pc.greater(pc.utf8_length(atoms), LONG)
        if pc.any(longer).as_py():
            chunks = pa.array([c for x in atoms.filter(longer).to_pylist() for c in _chunks(x, longest)], pa.string()).unique()
            atoms = pa.concat_arrays([atoms.filter(pc.invert(longer)), chunks])
        atoms = atoms.take(pc.sort_indices(atoms))
        bucket = key[0].as_py()
        for i in range(0, len(atoms), TOGETHER):
            part = atoms.slice(i, TOGETHER)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket, np.int32)), part], ["bucket", "part"])
        del atoms
        _trim()

    return run


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of text without nulls, and where each begins and the last ends."""
    places = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[places[0] : places[-1]], places - places[0]


class _Ids:
    """The ids of a bucket's atoms: one array of all, and each atom's place in it."""

    def __init__(self, names: list[str], ids: np.ndarray, of_byte: list[int]) -> None:
        self._pieces, self._ids, self._of_byte = pa.array(names), ids, of_byte
        self._found: list[tuple[pa.Array, pa.Array]] = []
        self._long: dict[str, str] = {}
        self._ready = False

    def add(self, part: pa.Array, lengths: pa.Array) -> None:
        """Atoms and the lengths of their pieces; a long atom's are kept by its key."""
        longer = pc.greater(pc.utf8_length(part), LONG)
        if pc.any(longer).as_py():
            self._long.update(zip(part.filter(longer).to_pylist(), lengths.filter(longer).to_pylist(), strict=True))
            part, lengths = part.filter(pc.invert(longer)), lengths.filter(pc.invert(longer))
        self._found.append((part, lengths))

    def _of(self, part: pa.Array, lengths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of atoms, one atom after the other, and how many each has."""
        size = np.zeros(256, np.int64)
        size[np.frombuffer(LENGTHS.encode(), np.uint8)] = np.arange(1, len(LENGTHS) + 1)
        (data, _), (codes, ends) = _texts(part), _texts(lengths)
        sizes, counts = size[codes], np.diff(ends).astype(np.int64)
        chars = np.append(np.nonzero((data & 0xC0) != 0x80)[0], len(data))
        stops = np.concatenate([[0], np.cumsum(sizes)])
        if stops[-1] != len(chars) - 1:
            raise ValueError("lengths of pieces don't fit their atoms")
        place = chars[stops]
        cut = pa.StringArray.from_buffers(len(sizes), pa.py_buffer(place.astype(np.int32)), pa.py_buffer(data.tobytes()))
        at = pc.index_in(cut, value_set=self._pieces).fill_null(-1).to_numpy()
        flat = self._ids[at].astype(np.int32)
        if (unknown := np.nonzero(at < 0)[0]).size:  # characters without a piece: their bytes' ids
            spelled = [[self._of_byte[b] for b in data[place[i] : place[i + 1]].tolist()] for i in unknown.tolist()]
            extra = np.array([len(x) for x in spelled])
            flat = np.insert(np.delete(flat, unknown), np.repeat(unknown - np.arange(len(unknown)), extra), [x for ids in spelled for x in ids])
            np.add.at(counts, np.repeat(np.arange(len(counts)), counts)[unknown], extra - 1)
        return flat, counts

    def _prepare(self) -> None:
        made = [self._of(*x) for x in self._found]
        self._atoms = pa.chunked_array([a for a, _ in self._found], pa.string()).combine_chunks()
        self._flat = np.concatenate([np.zeros(0, np.int32), *[f for f, _ in made]])
        self._count = np.concatenate([np.zeros(0, np.int64), *[c for _, c in made]])
        self._begin = np.cumsum(self._count) - self._count
        self._found, self._ready = [], True

    def of(self, splitter: Splitter, texts: pa.Array) -> pa.ListArray:
        """The ids of each text."""
        if not self._ready:
            self._prepare()
        parts, n_parts = splitter.parts_of(texts)
        dealt = parts.dictionary_encode()
        atoms, n_atoms = splitter.cut(dealt.dictionary)
        at = pc.index_in(atoms, value_set=self._atoms).fill_null(-1).to_numpy()
        flat, begin, count = self._flat, np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        known = at >= 0
        begin[known], count[known] = self._begin[at[known]], self._count[at[known]]
        for i in np.nonzero(~known)[0].tolist():  # atoms of over LONG characters
            atom = atoms[i].as_py()
            ids, _ = self._of(pa.array([atom]), pa.array([self._long[_key(atom)]]))
            begin[i], count[i], flat = len(flat), len(ids), np.concatenate([flat, ids])
        flat = flat[spread(begin, count)]
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(n_atoms)])]
        place = dealt.indices.to_numpy()
        of_part = np.diff(ends)[place]
        values = flat[spread(ends[:-1][place], of_part)]
        stops = np.concatenate([[0], np.cumsum(of_part)])[np.concatenate([[0], np.cumsum(n_parts)])]
        return pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(values))


def _assemble(ids: dict[str, int], of_byte: list[int], by_id: list[bytes]):
    """The ids of a bucket's documents, a block at a time; what they decode to is told by its crc32."""
    names, values_of = list(ids), np.array(list(ids.values()), np.int32)

    def run(key: tuple[pa.Scalar, ...], rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, spelling = _splitter(names), pa.array(by_id, pa.large_binary())
        found = _Ids(names, values_of, of_byte)

        def blocks() -> Iterator[pa.RecordBatch]:
            for some in rows:  # segmentations come first
                known = pc.is_valid(some.column("part"))
                if pc.any(known).as_py():
                    found.add(some.column("part").filter(known), some.column("lengths").filter(known))
                yield from _unpack(iter([some]))

        for batch in _gathered(blocks(), SLICE):
            texts = batch.column("text").take(pa.array(np.arange(batch.num_rows)))  # slices of their own
            values = found.of(splitter, texts)
            data, ends = _texts(texts.fill_null(""))
            view, ends = memoryview(data), ends.tolist()
            sums = [zlib.crc32(view[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
            back = [zlib.crc32(x) for x in decoded(values, spelling)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), values, pa.array(sums, pa.int64()), pa.array(back, pa.int64())], ["doc_id", "ids", "text_crc32", "decoded_crc32"])
        del found
        _trim()

    return run


_end = lambda x: F.shiftright(x, _WBITS + _KBITS)


def _edge(end: Column, k: Column) -> Column:
    """An edge as one long: its end, its weight and its length, so edges sort by ends."""
    weight = F.coalesce("weight", F.lit(_weight(UNKNOWN))) + _ZERO
    return F.shiftleft(end.cast("long"), _WBITS + _KBITS) + F.shiftleft(weight, _KBITS) + k


def _joined(spans: DataFrame, table: DataFrame) -> DataFrame:
    """Substrings (piece, of k characters) with their weights; those that are no piece only if they are one character."""
    # The piece table is the fixed public vocabulary, so its size is bounded.
    return spans.join(F.broadcast(table), "piece", "left").filter((F.col("k") == 1) | F.col("weight").isNotNull())


def lattices(parts: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """part, lengths (of the best pieces, a character of LENGTHS each) of distinct parts of up to LONG characters.

    parts is partitioned by part and all steps keep a part's rows together, so nothing is dealt
    again.
    """
    starts = parts.select("part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("s"))
    spans = starts.select("part", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("part") - F.col("s") + 1))).alias("k"))
    spans = spans.select("part", (F.col("s") + F.col("k") - 1).alias("e"), "k", F.substring("part", F.col("s"), F.col("k")).alias("piece"))
    lattice = _joined(spans, table).groupBy("part").agg(F.sort_array(F.collect_list(_edge(F.col("e"), F.col("k")))).alias("edges"))
    first = lambda x, i: (i == 0) | (_end(x) != _end(F.get(F.col("edges"), i - 1)))
    begins = F.filter(F.transform("edges", lambda x, i: F.when(first(x, i), i)), lambda i: i.isNotNull())
    placed = lattice.select("part", "edges", F.array_append(begins, F.size("edges")).alias("begins"))
    folded = placed.select("part", _best(F.col("edges"), F.col("begins")).alias("best"))
    return folded.select("part", _lengths(F.col("best")).alias("lengths"))


def long_lattices(chunks: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """part (a key), lengths of the long parts whose distinct chunks (part: key, number, text) are given."""
    cut = chunks.select(F.substring("part", 1, KEY).alias("key"), (F.conv(F.substring("part", KEY + 1, 8), 16, 10).cast("int") * CHUNK).alias("at"), F.expr(f"substring(part, {KEY + 9})").alias("text"))
    starts = cut.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(CHUNK), F.length("text")))).alias("s"))
    spans = starts.select("key", "at", "text", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("text") - F.col("s") + 1))).alias("k"))
    spans = spans.select("key", (F.col("at") + F.col("s") + F.col("k") - 2).alias("e"), "k", F.substring("text", F.col("s"), F.col("k")).alias("piece"))
    # Ends count from 0 here; inside an edge the end is that within its chunk.
    edges = _joined(spans, table).select("key", F.expr(f"e div {CHUNK}").alias("chunk"), _edge(F.col("e") % CHUNK, F.col("k")).alias("edge"))
    by_chunk = edges.groupBy("key", "chunk").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    whole = by_chunk.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "edges"))), lambda x: x["edges"]).alias("chunks"))
    folded = whole.select("key", _forward("chunks", longest).alias("codes"))
    return folded.select(F.col("key").alias("part"), _backward("codes").alias("lengths"))


def _code(k: Column) -> Column:
    return F.substring(F.lit(LENGTHS), k, F.lit(1))


def _forward(chunks: str, longest: int) -> Column:
    """For each chunk the length of the best piece that ends at each of its places, as characters of LENGTHS.

    The fold over a chunk's edges keeps the last scores only: what a fold holds is copied at each step.
    """
    state = lambda recent, codes, end, best: F.struct(recent.alias("recent"), codes.alias("codes"), end.alias("end"), best.alias("best"))
    length = lambda best: best.bitwiseAND(F.lit((1 << _KBITS) - 1)).cast("int")
    more = lambda s: F.array_append(F.slice(s["recent"], F.greatest(F.lit(1), F.size(s["recent"]) - longest + 2), F.lit(longest)), s["best"])
    recent = lambda s: F.when(s["end"] < 0, s["recent"]).otherwise(more(s))
    codes = lambda s: F.when(s["end"] < 0, s["codes"]).otherwise(F.concat(s["codes"], _code(length(s["best"]))))
    here = lambda s, x: state(s["recent"], s["codes"], s["end"], F.greatest(s["best"], _reach(s["recent"], x)))
    on = lambda s, x: state(recent(s), codes(s), _end(x), _reach(recent(s), x))
    step = lambda s, x: F.when(s["end"] == _end(x), here(s, x)).otherwise(on(s, x))
    begin = lambda done: state(F.element_at(done, -1)["recent"], F.lit(""), F.lit(-1).cast("long"), F.lit(0).cast("long"))
    settled = lambda s: F.struct(recent(s).alias("recent"), codes(s).alias("codes"))
    zero = F.array(F.struct(F.array(F.lit(0).cast("long")).alias("recent"), F.lit("").alias("codes")))
    done = F.aggregate(chunks, zero, lambda done, edges: F.array_append(done, F.aggregate(edges, begin(done), step, settled)))
    return F.transform(done, lambda d: d["codes"])


def _backward(codes: str) -> Column:
    """The lengths of the pieces on the way back from the last place, in reading order."""
    state = lambda skip, tail: F.struct(skip.cast("int").alias("skip"), tail.alias("tail"))
    chars = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.substring(c, F.greatest(F.lit(1), F.length(c)) - i + 1, F.lit(1)))
    taken = lambda s, ch: state(F.call_function("instr", F.lit(LENGTHS), ch) - 1, F.concat(s["tail"], ch))
    step = lambda s, ch: F.when(s["skip"] > 0, state(s["skip"] - 1, s["tail"])).otherwise(taken(s, ch))
    some = F.filter(F.reverse(codes), lambda c: c != "")
    zero = F.array(state(F.lit(0), F.lit("")))
    done = F.aggregate(some, zero, lambda done, c: F.array_append(done, F.aggregate(chars(c), state(F.element_at(done, -1)["skip"], F.lit("")), step)))
    return F.reverse(F.array_join(F.transform(done, lambda d: d["tail"]), ""))


def _reach(done: Column, x: Column) -> Column:
    """The score at the end of an edge over the scores so far, with the edge's length in the low bits."""
    low, own = (1 << _KBITS) - 1, (1 << (_WBITS + _KBITS)) - 1
    before = F.element_at(done, -x.bitwiseAND(F.lit(low)).cast("int")).bitwiseAND(F.lit(~low))
    return before + x.bitwiseAND(F.lit(own)) - (_ZERO << _KBITS)


def _best(edges: Column, begins: Column) -> Column:
    """For position 0 and each that follows one long: best score, and in the low bits the length of the piece that ends there.

    The greatest long has the best score and, of equal scores, the longest piece.
    """
    here = lambda p: F.slice(edges, F.get(begins, p - 1) + 1, F.get(begins, p) - F.get(begins, p - 1))
    places = F.sequence(F.lit(1), F.size(begins) - 1)
    return F.aggregate(places, F.array(F.lit(0).cast("long")), lambda done, p: F.array_append(done, F.array_max(F.transform(here(p), lambda x: _reach(done, x)))))


def _lengths(best: Column) -> Column:
    """The lengths of the pieces on the way back from the last position, in reading order."""
    start = F.struct(F.size(best).alias("at"), F.lit("").alias("found"))
    back = F.transform(F.reverse(best), lambda b, i: F.struct((F.size(best) - i).alias("p"), b.bitwiseAND(F.lit((1 << _KBITS) - 1)).cast("int").alias("k")))
    step = lambda s, b: F.when((b["p"] == s["at"]) & (b["k"] > 0), F.struct((s["at"] - b["k"]).alias("at"), F.concat(_code(b["k"]), s["found"]).alias("found"))).otherwise(s)
    return F.aggregate(back, start, step, lambda s: s["found"])


def encode(docs: DataFrame, model: str | None = None, finer: int = 1) -> DataFrame:
    """doc_id, ids, text_crc32 (of the text's UTF-8 form), decoded_crc32 (of what the ids decode to) of every row of docs.

    finer: that many times more buckets; they take less memory and move more bytes.
    """
    spark = docs.sparkSession
    path = model or default_piece_model()
    rows = piece_table(path)
    ids = {name: i for name, i, _ in rows}
    by_id, of_byte = _bytes_by_id(path)
    longest = max(map(len, ids))
    if longest > len(LENGTHS):
        raise ValueError(f"pieces of {longest} characters")
    table = spark.createDataFrame([(name, _weight(score)) for name, _, score in rows], "piece string, weight long")
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = partitions(spark, docs)
    buckets = finer * max(dealt, -(-held // BUCKET))
    tasks = min(buckets, 100_000)
    bucket = F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int")
    blocks = docs.select("doc_id", "text", bucket.alias("bucket")).mapInArrow(_pack, _BLOCKS).repartition(tasks, "bucket")
    parts = blocks.groupBy("bucket").applyInArrow(_atoms_of(list(ids), longest), _PARTS).filter("part is not null").repartition(dealt, "part")
    # All that reads parts asks for the same rows and columns, so that they share one exchange. A number below 1 changes
    # no comparison of lengths, but the optimizer can't move such a filter below that exchange.
    size = F.length("part") + F.rand(0)
    distinct = parts.groupBy("part").agg(F.max("bucket").alias("b")).filter("b >= 0").filter(size < LONG + 1)
    encoded = lattices(distinct.select("part"), table, longest).withColumnRenamed("part", "e_part")
    encoded = parts.join(encoded, F.col("part") == F.col("e_part")).select("bucket", "part", "lengths")
    long = parts.filter(size >= LONG + 1)
    chunks = long.groupBy("part").agg(F.max("bucket").alias("b")).filter("b >= 0").select("part")
    chunked = long_lattices(chunks, table, longest).withColumnRenamed("part", "e_part")
    asked = long.select("bucket", F.substring("part", 1, KEY).alias("part")).distinct()
    chunked = asked.join(chunked, F.col("part") == F.col("e_part")).select("bucket", "part", "lengths")
    # The union keeps the dealing by bucket; a bucket's segmentations sort before its blocks.
    found = encoded.unionAll(chunked).repartition(tasks, "bucket")
    found = found.select("bucket", F.lit(0).alias("kind"), "part", "lengths", F.lit(None).cast("binary").alias("block"))
    whole = found.unionAll(blocks.select("bucket", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("string").alias("lengths"), "block"))
    whole = whole.sortWithinPartitions("bucket", "kind").groupBy("bucket")
    return whole.applyInArrow(_assemble(ids, of_byte, by_id), "doc_id long, ids array<int>, text_crc32 long, decoded_crc32 long")


def _bytes_by_id(path: str) -> tuple[list[bytes], list[int]]:
    """What each id decodes to, and the id of each byte."""
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    by_id = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
    return by_id, [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]


def decoded(ids: pa.ListArray, texts: pa.Array) -> Iterator[memoryview]:
    """The UTF-8 forms of lists of ids by texts, each id's, without the space that was put in front; some lists at a time."""
    for k in range(0, len(ids), 256):
        part = ids.slice(k, 256)
        ends = part.offsets.to_numpy().astype(np.int64)
        taken = texts.take(part.flatten())
        place = np.frombuffer(taken.buffers()[1], np.int64)[ends - ends[0]].tolist() if len(taken) else [0] * len(ends)
        data = memoryview(taken.buffers()[2] or b"") if len(taken) else memoryview(b"")
        for i, j in zip(place, place[1:], strict=False):
            yield data[i + 1 : j] if i < j and data[i] == 32 else data[i:j]


def _decoder(by_id: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelling = pa.array(by_id, pa.large_binary())
        for batch in batches:
            keep = [batch.column(c) for c in batch.schema.names]
            texts = [bytes(x).decode("utf-8", "replace") for x in decoded(batch.column("ids"), spelling)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded (a column ids without nulls, and others) with decoded, the text of the ids."""
    from pyspark.sql.types import StringType, StructField, StructType

    by_id, _ = _bytes_by_id(model or default_piece_model())
    return encoded.mapInArrow(_decoder(by_id), StructType([*encoded.schema.fields, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, model: str | None = None, finer: int = 1) -> DataFrame:
    """doc_id, n_pieces, ids, text_crc32, decoded_crc32 of every row: its ids, and whether they give its text back.

    Ids are decoded where they are made, so that a task needs one Python worker.
    """
    rows = encode(docs, model, finer)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "text_crc32", "decoded_crc32")
