"""SentencePiece encoding and decoding by suffix-array matching.

The words of a batch are joined into one text and all its suffixes sorted; every vocabulary piece finds its
occurrences as one range of the array by binary search. The occurrences are edges of a lattice; sorted by
position, they are relaxed from left to right. For a byte-pair vocabulary an edge relaxes its end if its piece
stays next to the piece that reached its start, that is if merging both strings by rank gives just these two
back; each place then has exactly one last piece, and following them back gives the encoding.

No piece may hold a space after another character (checked on loading), so words, each with the blanks before
it, are independent and a batch needs each distinct word once. Rows are encoded where they are scanned: no
shuffle, and memory is bounded by ``GROUP`` characters of distinct words (or one longer word) at a time.

Defined results: null text counts as empty and has no ids; characters outside the vocabulary become byte
pieces; the sign U+2581 is a space, as in the library; repeated rows are encoded each; an empty table gives no
rows; extra columns are carried only on request. Decoding null or no ids gives an empty text; bytes that are
not UTF-8 give U+FFFD each.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Bytes of distinct words that are indexed together.
GROUP = 1 << 18
#: Words that a worker remembers; forgetting them costs time only.
REMEMBERED = 300_000
#: Bits of the number of slots for tested pairs.
TESTED = 20

_WORD = re.compile(r" *[^ ]+| +")
_vocabularies: dict[str, Vocabulary] = {}
codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


class Vocabulary:
    """A byte-pair SentencePiece model: its pieces as bytes with plain spaces, and the lattice search."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("only byte-pair models are supported")
        kind = proto.ModelProto.SentencePiece
        n = len(model.pieces)
        self.rank: dict[str, float] = {}
        self.out: list[bytes] = [b""] * n
        self.id: dict[str, int] = {}
        self.byte_id = np.zeros(256, np.uint32)
        for i, p in enumerate(model.pieces):
            if p.type == kind.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.out[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kind.UNKNOWN:
                self.out[i] = model.trainer_spec.unk_surface.encode()
            elif p.type == kind.NORMAL:
                text = p.piece.replace("▁", " ")
                self.rank[text], self.id[text], self.out[i] = p.score, i, text.encode()
            elif p.type != kind.CONTROL:
                raise ValueError("user-defined pieces are not supported")
        if any(re.search("[^ ] ", x) or any(c not in self.id for c in x) for x in self.id):
            raise ValueError("pieces must not span words and must consist of pieces")
        self.n = n
        self.none, self.foreign = n, n + 1  # before a word; a character outside the vocabulary
        self.name = {i: x for x, i in self.id.items()}
        self.width = -(-max(len(x.encode()) for x in self.id) // 8)
        order = sorted((x.encode(), i) for x, i in self.id.items())
        self.piece_id = np.array([i for _, i in order])
        self.piece_len = np.array([len(x) for x, _ in order])
        size = 8 * self.width
        raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x, _ in order), f"S{size}")
        top = np.frombuffer(b"".join(x.ljust(size, b"\xff") for x, _ in order), f"S{size}")
        self.low, self.high = raw, top
        first8 = lambda fill: np.frombuffer(b"".join(x[:8].ljust(8, fill) for x, _ in order), ">u8").astype(np.uint64)
        self.low8, self.high8 = first8(b"\0"), first8(b"\xff")
        # pairs tested last, each in its slot: the pair's number and, in the lowest bit, whether it stays apart
        self.tested = np.full(1 << TESTED, -2)
        # ids of words with one blank before them (by what follows it), and of all others
        self.spaced: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self._learn_merges()

    def _learn_merges(self) -> None:
        """For every piece the time of its merge (its rank; 0 for a character) and the two parts merged last."""
        lens = np.array([len(self.name.get(i, "")) for i in range(self.n)])
        scores = [-self.rank[self.name[i]] if lens[i] > 1 else -np.inf for i in range(self.n)]
        self.time = np.unique(scores, return_inverse=True)[1].astype(np.int64)
        self.left, self.right = np.full(self.n, -1), np.full(self.n, -1)
        splits = [(i, self.id[x[:k]], self.id[x[k:]]) for x, i in self.id.items() for k in range(1, len(x)) if x[:k] in self.id and x[k:] in self.id]
        whole, a, b = np.array(splits or np.zeros((0, 3)), np.int64).T
        order = np.argsort(a * self.n + b)
        self.pair_key, self.pair_time = (a * self.n + b)[order], self.time[whole[order]]
        size = lens[whole]
        reached = lens == 1
        for n in np.unique(size):  # parts are shorter, so they are known by then
            k = np.flatnonzero(size == n)
            k = k[reached[a[k]] & reached[b[k]]]
            k = k[self.apart(a[k], b[k], 2 * self.time[whole[k]])]
            if (np.maximum(self.time[a[k]], self.time[b[k]]) > self.time[whole[k]]).any():
                raise ValueError("a piece must not be merged from one of worse rank")
            self.left[whole[k]], self.right[whole[k]] = a[k], b[k]
            reached[whole[k]] = True
        self.reached = np.append(reached, [True, True])

    def apart(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether neighbours a and b stay apart when the text of both is merged by rank.

        Their merges are taken back one by one, the latest first (of equal ranks the right one). Between two of
        them one pair stands at the border; it would merge if its rank were better than that of the merge
        that comes next, which is ``limit``: 2 rank on the left, where it would come first among equals, 2 rank + 1
        on the right."""
        out = np.ones(len(a), bool)
        if not len(self.pair_key):
            return out
        who, x, y = np.arange(len(a)), a, b
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit
        while len(who):
            key = x * self.n + y
            k = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            merges = (self.pair_key[k] == key) & (2 * self.pair_time[k] < limit)
            out[who[merges]] = False
            tx, ty = self.time[x], self.time[y]
            on = np.flatnonzero(~merges & ((tx > 0) | (ty > 0)))
            who, x, y, tx, ty = who[on], x[on], y[on], tx[on], ty[on]
            back = tx > ty
            limit = np.where(back, 2 * tx, 2 * ty + 1)
            x, y = np.where(back, self.right[x], x), np.where(back, y, self.left[y])
        return out

    def _valid(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece is whole when merged by itself and stays apart from the one before it."""
        out = self.reached[piece]
        both = np.flatnonzero(out & (before < self.n) & (piece < self.n))
        key = before[both] * self.n + piece[both]
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TESTED)).astype(np.int64)
        held = self.tested[slot]
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            held[new] = key[new] << 1 | self.apart(before[both[new]], piece[both[new]])
            self.tested[slot[new]] = held[new]
        out[both] = held & 1 == 1
        return out

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every occurrence of every piece in text (bytes, no piece holds a zero byte): position, id, length."""
        size = 8 * self.width
        padded = np.concatenate([text, np.zeros(size, np.uint8)])
        windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
        at = np.flatnonzero((text != 0) & ((text & 0xC0) != 0x80))  # characters start here
        words = [np.ascontiguousarray(windows[at + 8 * k]).view(">u8").ravel().astype(np.uint64) for k in range(self.width)]
        order = np.argsort(words[0])
        for k in range(1, self.width):  # ties of the first 8 k bytes are sorted by the next 8
            tied = np.zeros(len(at) + 1, bool)
            tied[1:-1] = words[0][order[1:]] == words[0][order[:-1]]
            for w in words[1:k]:
                tied[1:-1] &= w[order[1:]] == w[order[:-1]]
            some = np.flatnonzero(tied[1:] | tied[:-1])
            if len(some):
                run = np.cumsum(~tied[some])
                order[some] = order[some][np.lexsort((words[k][order[some]], run))]
        suffixes = at[order]
        keys = np.empty((len(at), self.width), ">u8")
        for k, w in enumerate(words):
            keys[:, k] = w[order]
        keys = keys.view(f"S{size}").ravel()
        head = words[0][order]
        lo, hi = np.searchsorted(head, self.low8, "left"), np.searchsorted(head, self.high8, "right")
        some = np.flatnonzero(hi > lo)
        lo, hi = lo[some], hi[some]
        long = np.flatnonzero(self.piece_len[some] > 8)  # eight bytes bound the range of these, the rest narrows it
        lo[long] = np.searchsorted(keys, self.low[some[long]], "left")
        hi[long] = np.searchsorted(keys, self.high[some[long]], "right")
        count = hi - lo
        where = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return suffixes[where], np.repeat(self.piece_id[some], count), np.repeat(self.piece_len[some], count)

    def lattice(self, words: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        if not words:
            return []
        raws = [w.encode() for w in words]
        text = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
        lens = np.array([len(r) for r in raws])
        starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
        # zero bytes inside words are characters outside the vocabulary like others, so they may end a suffix key
        pos, ids, size = self.occurrences(text)
        begins = (text & 0xC0) != 0x80
        begins[starts + lens] = False
        alone = begins.copy()
        one = np.where(text < 128, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4)))
        alone[pos[size == one[pos]]] = False
        extra = np.flatnonzero(alone)
        pos = np.concatenate([pos, extra])
        ids = np.concatenate([ids, np.full(len(extra), self.foreign)])
        size = np.concatenate([size, one[extra]])
        depth = pos - np.repeat(starts, lens + 1)[pos]
        order = np.argsort(depth, kind="stable")
        pos, ids, size, depth = pos[order], ids[order], size[order], depth[order]
        last, came = np.full(len(text), -1), np.zeros(len(text), np.int64)
        last[starts] = self.none
        cuts = np.concatenate([np.flatnonzero(np.diff(depth, prepend=-1)), [len(depth)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            p, t = pos[a:b], ids[a:b]
            ok = last[p] >= 0
            ok[ok] = self._valid(last[p[ok]], t[ok])
            p, t, end = p[ok], t[ok], (pos[a:b] + size[a:b])[ok]
            last[end], came[end] = t, p
        # back from the ends, all words in step
        here, live = (starts + lens).copy(), np.flatnonzero(lens > 0)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            e = here[live]
            steps.append((e, last[e]))
            here[live] = came[e]
            live = live[here[live] > starts[live]]
        ends = np.concatenate([e for e, _ in steps]) if steps else np.zeros(0, np.int64)
        got = np.concatenate([t for _, t in steps]) if steps else np.zeros(0, np.int64)
        if (got < 0).any():
            raise RuntimeError("a word has no encoding")
        order = np.argsort(ends)
        ends, got = ends[order], got[order]
        if (got == self.foreign).any():  # spell these characters in bytes
            odd = got == self.foreign
            n = np.where(odd, ends - came[ends], 1)
            src = np.repeat(came[ends] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            got = np.where(np.repeat(odd, n), self.byte_id[text[np.minimum(src, len(text) - 1)]], np.repeat(got, n))
            ends = np.repeat(ends, n)
        flat = got.astype("<u4").tobytes()
        bound = (4 * np.searchsorted(ends, np.concatenate([starts, [len(text)]]), "right")).tolist()
        return [flat[a:b] for a, b in zip(bound, bound[1:])]

    def learn(self, words: set[str], known: dict[str, bytes], before: str) -> None:
        """Encode the words that are not known yet, each with ``before`` ahead of it, and add them."""
        if len(known) > REMEMBERED:  # the common ones stay
            kept = {w: known[w] for w in words & known.keys()}
            known.clear()
            known.update(kept)
        new = sorted(words - known.keys(), key=len)
        group = np.cumsum([len(w) + 2 for w in new]) // GROUP
        for part in np.split(np.arange(len(new)), np.flatnonzero(np.diff(group)) + 1):
            some = [new[k] for k in part]
            known.update(zip(some, self.lattice([before + w for w in some])))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit values."""
        at = 0
        while at < len(texts):
            parts: list[tuple[dict[str, bytes], list[str]]] = []
            total = 0
            while at < len(texts) and total < 2 * GROUP:
                plain = self.library.normalize(texts[at]).replace("▁", " ") if texts[at] else ""
                if plain.startswith(" ") and "  " not in plain:
                    parts.append((self.spaced, plain[1:].split(" ")))
                else:
                    parts.append((self.others, _WORD.findall(plain)))
                total += len(plain)
                at += 1
            self.learn(set().union(*(p for d, p in parts if d is self.spaced)), self.spaced, " ")
            self.learn(set().union(*(p for d, p in parts if d is self.others)), self.others, "")
            for known, p in parts:
                yield b"".join(map(known.__getitem__, p))

    def decode(self, ids: list[int]) -> str:
        text = b"".join([self.out[i] for i in ids]).decode("utf-8", "each_byte")
        first = next((i for i in ids if self.out[i]), self.none)  # only a piece's own space is the added one
        return text[1:] if self.name.get(first, "").startswith(" ") else text


def vocabulary(path: str | None = None) -> Vocabulary:
    """The model at path, else the public 32k byte-pair one; loaded once per worker."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def _with(df: DataFrame, column: str, keep: tuple[str, ...], added: list[T.StructField], work) -> DataFrame:
    """The kept columns and those that ``work`` makes of one column, batch by batch."""
    inner = [f"k{i}" for i in range(len(keep))]
    picked = df.select(F.col(column).alias("t"), *[F.col(c).alias(i) for c, i in zip(keep, inner)])
    schema = T.StructType([*picked.schema.fields[1:], *[T.StructField(f"a{i}", f.dataType) for i, f in enumerate(added)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *work(part.column(0))], schema.names)

    return picked.mapInArrow(run, schema).toDF(*keep, *[f.name for f in added])


def encode(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The kept columns with ids (array), ids_crc32 (of little-endian unsigned 32-bit ids) and n_bytes (byte pieces)."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_crc32", T.LongType()), T.StructField("n_bytes", T.LongType())]

    def work(column: pa.Array) -> list[pa.Array]:
        v = vocabulary(path)
        is_byte = np.zeros(v.n, bool)
        is_byte[v.byte_id] = True
        raws = list(v.encode(column.to_pylist()))
        flat = np.frombuffer(b"".join(raws), "<u4")
        at = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raws])])
        spelled = np.concatenate([[0], np.cumsum(is_byte[flat])])
        ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32)))
        return [ids, pa.array([zlib.crc32(r) for r in raws], pa.int64()), pa.array(spelled[at[1:]] - spelled[at[:-1]], pa.int64())]

    return _with(df, text_col, keep, added, work)


def decode(df: DataFrame, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, name: str = "decoded") -> DataFrame:
    """The kept columns with the text of the ids."""

    def work(column: pa.Array) -> list[pa.Array]:
        v = vocabulary(path)
        return [pa.array([v.decode(x.as_py() or []) for x in column], pa.string())]

    return _with(df, ids_col, keep, [T.StructField(name, T.StringType())], work)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, their crc, byte pieces, and the hash of the text that decoding gives back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = F.coalesce(F.replace("text", F.lit("▁"), F.lit(" ")), F.lit(""))
    docs = docs.withColumn("want", F.sha2(plain.cast("binary"), 256))
    coded = encode(docs, keep=("doc_id", "want")).withColumn("n_ids", F.size("ids").cast("long"))
    back = decode(coded, keep=("doc_id", "n_ids", "ids_crc32", "n_bytes", "want"))
    back = back.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256))
    return back.select("doc_id", "n_ids", "ids_crc32", "n_bytes", "decoded_sha256", (F.col("decoded_sha256") == F.col("want")).alias("round_trip"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
