"""SentencePiece encoding by a streaming Viterbi search over the model's pieces, and decoding.

The search keeps one survivor for each position: the last piece of the best path up to it. Whenever the survivors' paths from all
positions that a later piece may follow run through one boundary, the ids up to it are committed and their text is let go, so
memory doesn't follow the text, and only positions within the longest piece's length matter. Which path survives depends on the model:

- a unigram model's survivor has the largest sum of scores; ties go to the longer last piece;
- a BPE model merges the best-scored neighbours, the leftmost first. A sequence of pieces is what merging leaves exactly where that holds for
  each two neighbours in it: the first merge across a boundary would happen between these two alone as well. So a position has one survivor,
  the piece that fits the survivor of the position it begins at, and the ids are the library's.

No piece of the model holds a space behind another character, so all surviving paths meet at every space that follows a non-space: that
commit needs no tracing, and what is committed there depends only on the segment before it. Distinct segments of a slice of texts
are therefore searched once, many side by side (``lockstep``): all advance by one position at a time, in numpy, over the pieces as a
double-array trie, and commit by the same rule. Segments too long for its window are streamed one by one (``StreamingViterbi``).

Edge cases: null and empty texts have no ids; characters outside the vocabulary become byte pieces; the mark U+2581 in
a text is a space, as in the library; repeated rows are encoded each; an empty table gives no row; further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ptclake.llm.common import crc_of_runs, ragged, slices, texts_of

#: Segments of more characters than so many times the longest piece are streamed one by one.
WINDOW = 4
#: Segments that advance side by side.
LANES = 1 << 13


class Trie:
    """Pieces as a double array: the child of node s by character code c is ``base[s] + c`` where ``check`` of that is s."""

    def __init__(self, pieces: list[str]):
        often: dict[str, int] = {}
        for p in pieces:
            for c in p:
                often[c] = often.get(c, 0) + 1
        #: codes of characters, the most frequent ones first; 0 for all others
        self.codes = np.zeros(0x110000, np.int32)
        for k, c in enumerate(sorted(often, key=lambda c: (-often[c], c))):
            self.codes[ord(c)] = k + 1
        children: dict[str, set[str]] = {"": set()}
        for p in pieces:
            for k in range(len(p)):
                children.setdefault(p[:k], set()).add(p[k])
        size = 2 * sum(map(len, children.values())) + 2 * len(often) + 2
        free, base, check = np.ones(4 * size, bool), np.zeros(4 * size, np.int64), np.full(4 * size, -1, np.int64)
        free[0] = False  # the root
        codes = {p: np.sort(self.codes[[ord(c) for c in cs]]).astype(np.int64) for p, cs in children.items()}
        placed, single, low = {}, [], 1
        for p in sorted(children, key=lambda p: (-len(children[p]), p)):
            own = codes[p]
            if len(own) == 1:
                single.append(p)
                continue
            while not free[low]:
                low += 1
            start = max(low, int(own[0]))
            while p not in placed:
                slots = np.flatnonzero(free[start : start + 1024]) + start - own[0]
                fits = free[slots[:, None] + own].all(axis=1)
                if fits.any():
                    placed[p] = int(slots[int(fits.argmax())])
                start += 1024
            low = max(low, start - 4096)  # what lies further behind is nearly full
            free[placed[p] + own] = False
        # nodes with one child take any free slot
        slots = np.flatnonzero(free)
        for p, slot in zip(single, slots[slots > len(often)].tolist(), strict=False):
            placed[p] = slot - int(codes[p][0])
            free[slot] = False
        self.place = {"": 0}  # nodes are named by their place, which the parent's base gives: parents come before children
        for p in sorted(children, key=len):
            at, s = placed[p], self.place[p]
            base[s] = at
            check[at + codes[p]] = s
            for c in children[p]:
                self.place[p + c] = at + int(self.codes[ord(c)])
        end = int(np.flatnonzero(~free)[-1]) + len(often) + 2
        self.base, self.check = base[:end], check[:end]


class Merges:
    """Which two pieces may stand side by side in a BPE model's output; answers are remembered in tables of fixed size."""

    def __init__(self, scores: dict[str, float], names: dict[int, str]):
        self.scores, self.names, self.steps = scores, names, {}
        self.keys, self.fits = np.full(1 << 21, -1, np.int64), np.zeros(1 << 21, bool)

    def sequence(self, node: int) -> list[tuple[float, str | None, str | None]] | None:
        """The merges that make a piece of its characters: score, and the new first or last symbol; None where merging ends otherwise."""
        if node not in self.steps:
            symbols, out = list(self.names[node]), []
            while out is not None and len(symbols) > 1:
                found = [self.scores.get(x + y, -np.inf) for x, y in zip(symbols, symbols[1:])]
                best = max(found)
                if best == -np.inf:
                    out = None
                    break
                at = found.index(best)
                made = symbols[at] + symbols[at + 1]
                out.append((best, made if at == 0 else None, made if at == len(symbols) - 2 else None))
                symbols[at : at + 2] = [made]
            self.steps[node] = out
        return self.steps[node]

    def fit(self, left: int, right: int) -> bool:
        """Whether merging the characters of both leaves just these two; ``left`` is 0 at a start and -1 for a character of no piece."""
        b = self.sequence(right)
        if b is None or left <= 0:
            return b is not None
        a, x, y, i, j = self.sequence(left), self.names[left][-1], self.names[right][0], 0, 0
        while True:
            across = self.scores.get(x + y, -np.inf)
            next_a, next_b = a[i][0] if i < len(a) else -np.inf, b[j][0] if j < len(b) else -np.inf
            if across > next_a and across >= next_b:  # of equal scores, the leftmost goes first
                return False
            if i == len(a) and j == len(b):
                return True
            if next_a >= next_b:
                x, i = a[i][2] or x, i + 1
            else:
                y, j = b[j][1] or y, j + 1

    def fitting(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fit`` of many pairs."""
        key = (left.astype(np.int64) + 1 << 24) | right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        out, new = self.fits[slot], np.flatnonzero(self.keys[slot] != key)
        if len(new):
            asked, first, which = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array([self.fit((k >> 24) - 1, k & (1 << 24) - 1) for k in asked.tolist()], bool)
            out[new] = found[which]
            at = slot[new][first]
            self.keys[at], self.fits[at] = asked, found
        return out


def proto_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values (numbers, or bytes as they stand) of a protocol buffers message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at, value, shift = at + 1, value | (byte & 127) << shift, shift + 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else 8 if key & 7 == 1 else 4
            yield key >> 3, data[at : at + size]
            at += size


def is_bpe(model: bytes) -> bool:
    """Whether a model file is of the BPE type (else unigram); an error for other types and for what this encoder doesn't do to texts."""
    parts = dict(x for x in proto_fields(model) if x[0] in (2, 3))
    trainer, normalizer = (dict(proto_fields(parts.get(k, b""))) for k in (2, 3))
    kind = trainer.get(3, 1)
    wrong = [text for text, is_so in (("a model that is neither unigram nor BPE", kind not in (1, 2)), ("white space as a suffix", trainer.get(24, 0)), ("a normaliser other than identity", normalizer.get(2, b"")), ("no dummy prefix", not normalizer.get(3, 1)), ("removal of extra spaces", normalizer.get(4, 1)), ("spaces that aren't escaped", not normalizer.get(5, 1))) if is_so]
    if wrong:
        raise ValueError("the model file asks for " + ", ".join(wrong))
    return kind == 2


class Vocabulary:
    """Pieces, scores and byte pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        merged = is_bpe(model.serialized_model_proto())
        n = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i).replace("▁", " "): i for i in plain}
        scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.unknown_score, self.unknown_id = min(scores.values()) - 10.0, model.unk_id()
        self.longest = max(map(len, scores))
        if any(" " in p.lstrip(" ") for p in scores):
            raise ValueError("a piece spans a space: texts can't be cut there")
        parts = [b""] * n
        for p, i in self.ids.items():
            parts[i] = p.encode()
        for b, i in self.bytes.items():
            parts[i] = bytes([b])
        self.lengths = np.fromiter(map(len, parts), np.int64, n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        #: characters that pieces hold, but that are none themselves, can stand alone as unknown ones
        alone = sorted({c for p in scores for c in p} - set(scores))
        self.trie = Trie([*scores, *alone])
        #: by node of the trie: whether a piece ends there, its score, id (-1 for an unknown character) and length
        size = len(self.trie.base)
        self.token, self.node_score = np.zeros(size, bool), np.full(size, -np.inf)
        self.node_id, self.node_length = np.full(size, -1, np.int64), np.ones(size, np.int64)
        for p in [*scores, *alone]:
            s = self.trie.place[p]
            self.token[s], self.node_score[s], self.node_id[s], self.node_length[s] = True, scores.get(p, self.unknown_score), self.ids.get(p, -1), len(p)
        # a BPE model's scores are the numbers of its merges
        self.merges = Merges(scores, {s: p for p, s in self.trie.place.items()}) if merged else None

    def of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown_id]


class StreamingViterbi:
    """Feeds text (spaces as they are, the prefix already added) and gives committed ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text, self.at = "", 0  # text from the last committed boundary; positions before `at` have been extended
        self.best: list[float | None] = [0.0]
        self.back: list[int] = [0]
        self.last: list[int] = [0]  # the survivor's last piece; 0 at the start
        self.widest = self.commits = 0  # the longest uncommitted text, and the commits, so far

    def feed(self, text: str, last: bool = False) -> list[int]:
        out: list[int] = []
        step = 2 * self.v.longest  # text is taken in bounded parts, so that each commit moves a bounded rest
        for k in range(0, len(text), step):
            self.text += text[k : k + step]
            grow = len(self.text) + 1 - len(self.best)
            self.best += [None] * grow
            self.back += [0] * grow
            self.last += [0] * grow
            out += self._advance(len(self.text) - self.v.longest)
        if last:
            out += self._advance(len(self.text))
            out += self._ids(len(self.text))
            self.text, self.at, self.best, self.back, self.last = "", 0, [0.0], [0], [0]
        return out

    def _advance(self, end: int) -> list[int]:
        """Extends the positions before ``end``, then commits if there is enough text behind the last boundary."""
        while self.at < end:
            self._extend(self.at)
            self.at += 1
        self.widest = max(self.widest, len(self.text))
        return self._commit() if self.at >= self.v.longest else []

    def _extend(self, i: int) -> None:
        v, text, best, place = self.v, self.text, self.best, self.v.trie.place

        def offer(j: int, node: int, score: float) -> None:
            if best[j] is None or not v.merges and best[i] + score > best[j]:
                best[j], self.back[j], self.last[j] = best[i] + score, i, node

        single = False
        for j in range(i + 1, min(len(text), i + v.longest) + 1):
            node = place.get(text[i:j])
            if node is None:
                break
            if v.token[node]:
                single = True if j == i + 1 else single
                if not v.merges or v.merges.fit(self.last[i], node):
                    offer(j, node, v.node_score[node])
        if not single:
            offer(i + 1, -1, v.unknown_score)

    def _ids(self, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > 0:
            cuts.append(self.back[cuts[-1]])
        return [i for b, a in zip(cuts[-2::-1], cuts[:0:-1], strict=True) for i in self.v.of(self.text[a:b])]

    def _commit(self) -> list[int]:
        """Positions that a later piece may follow are those from ``at`` on that have a path; if their paths meet, commit up to there."""
        live = {k for k in range(self.at, min(len(self.text), self.at + self.v.longest) + 1) if self.best[k] is not None}
        while len(live) > 1:
            top = max(live)
            live.remove(top)
            live.add(self.back[top])
        (meet,) = live
        if not meet:
            return []
        ids = self._ids(meet)
        base = self.best[meet]
        self.text, self.at = self.text[meet:], self.at - meet
        self.best = [None if x is None else x - base for x in self.best[meet:]]
        self.back = [max(0, x - meet) for x in self.back[meet:]]
        self.last = self.last[meet:]
        self.commits += 1
        return ids


def lockstep(v: Vocabulary, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of pieces by segment: the node of the piece that ends behind each character (0 where none does, -1 for an unknown character).

    Segments are ranges of the code points ``text``, the longest first. Scores are kept for the positions within the longest piece's reach,
    nodes until they are committed. Returns nodes (position, segment), and the commits before its end per segment.
    """
    n, width, reach = len(starts), int(lengths[0]), v.longest
    active = np.searchsorted(-lengths, -np.arange(1, width + 1), side="right")  # segments with more than t characters
    codes = np.zeros((width, n), np.int32)
    for t in range(width):
        codes[t, : active[t]] = v.trie.codes[text[starts[: active[t]] + t]]
    best = np.full((reach + 1, n), -np.inf)  # position p is in row p % (reach + 1)
    best[0] = 0.0
    node = np.zeros((width + 1, n), np.int32)  # the best last piece up to each position
    out = np.zeros((width + 1, n), np.int32)
    done, commits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    base, check, score = v.trie.base, v.trie.check, v.node_score

    def write(rows: np.ndarray, ends: np.ndarray) -> None:
        """Follows the paths from ``ends`` back to what is committed and writes their pieces."""
        at = ends
        while len(rows):
            last = node[at, rows]
            out[at, rows] = last
            at = at - v.node_length[last]
            on = at > done[rows]
            rows, at = rows[on], at[on]

    for t in range(width):
        here = best[t % (reach + 1)]
        rows, s, single = np.arange(active[t]), np.zeros(active[t], np.int32), np.zeros(active[t], bool)
        for k in range(1, reach + 1):
            if t + k > width:
                break
            inside = active[t + k - 1]
            if len(rows) and rows[-1] >= inside:
                some = np.searchsorted(rows, inside)
                rows, s = rows[:some], s[:some]
            child = base[s] + codes[t + k - 1, rows]
            on = (check[child] == s) & (child > 0)
            rows, s = rows[on], child[on]
            if not len(rows):
                break
            ends = v.token[s]
            if k == 1:
                single[rows] = ends
            w, piece = rows[ends], s[ends]
            ahead, total = best[(t + k) % (reach + 1)], here[w] + score[piece]
            better = v.merges.fitting(node[t, w], piece) if v.merges else total > ahead[w]
            w = w[better]
            ahead[w], node[t + k, w] = total[better], piece[better]
        odd = np.flatnonzero(~single)
        if len(odd):
            # characters of no piece stand alone: nothing else leads across them
            best[(t + 1) % (reach + 1)][odd], node[t + 1, odd] = here[odd] + v.unknown_score, -1
        here[:] = -np.inf
        if (t + 1) % reach == 0 and (rest := active[t + 1] if t + 1 < width else 0):
            # segments that go on: commit where the paths to all positions with a path meet
            ahead = np.arange(t + 1, min(width, t + reach) + 1)
            live = np.where(best[ahead % (reach + 1), :rest] > -np.inf, ahead[:, None], t + 1)
            while True:
                top = live.max(axis=0)
                apart = np.flatnonzero((live != top).any(axis=0))
                if not len(apart):
                    break
                before = top[apart] - v.node_length[node[top[apart], apart]]
                live[:, apart] = np.where(live[:, apart] == top[apart], before, live[:, apart])
            meet = np.flatnonzero(top > done[:rest])
            write(meet, top[meet])
            done[meet] = top[meet]
            commits[meet] += 1
    rest = np.flatnonzero(lengths > done)
    write(rest, lengths[rest])
    return out, commits


class PieceEncoder:
    """Encodes texts with a SentencePiece model file; ``commits`` counts those made by tracing paths to where they meet."""

    def __init__(self, path: str):
        self.vocabulary, self.commits = Vocabulary(path), 0

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets per text and the ids of all texts. No nulls in ``texts``."""
        given = texts.to_pylist()
        # the library puts a space before a text; runs of spaces stay
        joined = "".join([" " + t for t in given if t]).replace("▁", " ")
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in given), np.int64, len(given))
        ends = np.cumsum(sizes)
        begins = np.zeros(len(points) + 1, bool)
        if len(points):
            space = points == 32
            begins[1:-1] = space[1:] & ~space[:-1]
            begins[np.unique(ends - sizes)] = True
        begins[-1] = False
        cuts = np.flatnonzero(begins)  # first characters of segments
        utf8 = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(utf8)])
        coded = pa.LargeStringArray.from_buffers(len(cuts), pa.py_buffer(np.append(at[cuts], at[-1])), pa.py_buffer(joined.encode())).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary
        each, flat = self._segments(words)
        first = np.cumsum(each) - each
        ids = flat[ragged(first[codes], each[codes])]
        upto = np.concatenate([[0], np.cumsum(each[codes])])
        return upto[np.searchsorted(cuts, np.concatenate([[0], ends]))], ids

    def _segments(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids per distinct segment, and all their ids."""
        v = self.vocabulary
        data = "".join(words.to_pylist())
        points = np.frombuffer(data.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        counts, parts = np.zeros(len(words), np.int64), []
        long = int(np.searchsorted(-sizes[order], -WINDOW * v.longest, side="left"))
        for i in order[:long].tolist():
            stream = StreamingViterbi(v)
            found = np.array(stream.feed(data[starts[i] : starts[i] + sizes[i]], last=True), np.int64)
            counts[i] = len(found)
            self.commits += stream.commits
            parts.append(found)
        for a in range(long, len(order), LANES):
            own = order[a : a + LANES]
            nodes, commits = lockstep(v, points, starts[own], sizes[own])
            self.commits += int(commits.sum())
            row, pos = np.nonzero(nodes.T)
            node = nodes.T[row, pos]
            ids, per = v.node_id[node], np.ones(len(node), np.int64)
            if (odd := np.flatnonzero(ids < 0)).size:
                other = [v.of(chr(c)) for c in points[starts[own][row[odd]] + pos[odd] - 1].tolist()]
                per[odd] = [len(x) for x in other]
                wide = np.repeat(ids, per)
                wide[ragged((np.cumsum(per) - per)[odd], per[odd])] = np.concatenate(other)
                ids = wide
            counts[own] = np.bincount(row, weights=per, minlength=len(own)).astype(np.int64)
            parts.append(ids)
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        # back from the order of length to that of the dictionary
        sorted_counts = counts[order]
        place = np.zeros(len(order), np.int64)
        place[order] = np.cumsum(sorted_counts) - sorted_counts
        return counts, flat[ragged(place, counts)].astype("<u4")

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, bytes]:
        """The UTF-8 text of each run of ids, as offsets into all bytes; each text has the space that encoding puts first."""
        v = self.vocabulary
        n = v.lengths[ids]
        return np.concatenate([[0], np.cumsum(n)])[offsets], v.flat[ragged(v.starts[ids], n)].tobytes()

    def decode_texts(self, offsets: np.ndarray, ids: np.ndarray) -> list[bytes]:
        at, flat = self.decode(offsets, ids)
        return [flat[a + 1 : b] if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                offsets, ids = encoder(model).encode(texts_of(b))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets.astype(np.int32), ids.astype(np.int32))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(rows: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids`` to ``doc_id, text``; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            texts = encoder(model).decode_texts(offsets - offsets[0], lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def same_texts(at: np.ndarray, flat: bytes, texts: pa.Array) -> np.ndarray:
    """Which of the decoded runs equal their text."""
    _, own, raw = texts.buffers()
    own, raw = np.frombuffer(own, np.int64, len(texts) + 1), memoryview(raw or b"").cast("B")
    runs = zip(at[:-1].tolist(), at[1:].tolist(), own[:-1].tolist(), own[1:].tolist(), strict=True)
    view = memoryview(flat)
    return np.fromiter((view[a + (b > a) : b] == raw[c:d] for a, b, c, d in runs), bool, len(texts))


def piece_digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: n_ids, the CRC-32 of its ids, and what decoding them gives back: n_bytes and whether it is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                texts = texts_of(b)
                offsets, ids = encoder(model).encode(texts)
                at, flat = encoder(model).decode(offsets, ids)
                n_bytes = np.maximum(0, np.diff(at) - 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets)), pa.array(crc_of_runs(ids, offsets)), pa.array(n_bytes), pa.array(same_texts(at, flat, texts))], names=["doc_id", "n_ids", "ids_crc32", "n_bytes", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, n_bytes long, round_trip boolean")
