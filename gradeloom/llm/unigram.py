"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gradeloom.llm.common import Shipped

MARK = "▁"  # stands for a space inside pieces
UNKNOWN_PENALTY = 10.0
#: Segments of text whose pieces a task remembers beyond those of its last texts (some 200 bytes each), and the longest segment that is solved together with others.
MEMO, TOGETHER = 60_000, 64


class DoubleArray:
    """base and check arrays over bytes; node 0 is the root, and a child of s by byte c is base[s] + c + 1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for key, v in keys.items():
            s = 0
            for c in key:
                if c not in children[s]:
                    children[s][c] = len(children)
                    children.append({})
                    value.append(-1)
                s = children[s][c]
            value[s] = v
        size = 1 << 16
        base, check, out, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
        place, todo, free, recent = {0: 0}, [0], 1, 1
        check[0], used[0] = 0, True
        while todo:
            node = todo.pop()
            s = place[node]
            out[s] = value[node]
            if not children[node]:
                continue
            kids = np.array(sorted(children[node])) + 1
            # nodes with many children start near where the last one fitted, and leave the gaps before to the others
            at, window = max(0, (free if len(kids) == 1 else recent) - int(kids[0])), 64
            while True:  # first fit: the smallest base from here on whose slots are all free
                if at + window + 512 >= size:
                    base, check, out, used = (np.concatenate((x, np.full(size, fill, x.dtype))) for x, fill in ((base, 0), (check, -1), (out, -1), (used, False)))
                    size *= 2
                fits = ~used[at + np.arange(window)[:, None] + kids[None, :]].any(axis=1)
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += window
                window = min(2 * window, 1 << 12)
            base[s] = at
            if len(kids) > 1:
                recent = max(recent, at - 256)
            for c, t in zip(kids.tolist(), (at + kids).tolist()):
                used[t], check[t], place[children[node][c - 1]] = True, s, t
                todo.append(children[node][c - 1])
            while used[free]:
                free += 1
        self.base, self.check, self.value = base, check, out


class Unigram:
    """A piece table with log scores. ``pieces``: (bytes, score, kind), kind 'piece', 'byte' or 'control'."""

    def __init__(self, pieces: list[tuple[bytes, float, str]], unknown: int = 0):
        self.bytes = [b"" if kind == "control" else b for b, _, kind in pieces]
        mark = MARK.encode()
        self.plain = [b.replace(mark, b" ") if kind == "piece" else b for b, (_, _, kind) in zip(self.bytes, pieces)]  # a byte piece stands for itself
        self.unknown = unknown
        self.byte_ids = np.full(256, unknown, np.int32)
        for i, (b, _, kind) in enumerate(pieces):
            if kind == "byte":
                self.byte_ids[b[0]] = i
        own = {b: i for i, (b, _, kind) in enumerate(pieces) if kind == "piece" and b}
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        self.least = min((s for _, s, kind in pieces if kind == "piece"), default=0.0) - UNKNOWN_PENALTY
        self.trie = DoubleArray(own)
        inner = any(mark in re.sub(b"^(?:%s)+" % mark, b"", b) for b in own)
        lines = any(b"\n" in b for b in own)
        # a piece has marks at its start only, so text splits before each run of spaces; also around line ends if no piece has one
        # a literal mark is no space, so it stands alone and goes by its bytes
        self.split = re.compile(f"{MARK}|[^{MARK}]+" if inner else f"{MARK}| +[^ {MARK}]*|[^ {MARK}]+" if lines else f"{MARK}| +[^ \n{MARK}]*|[^ \n{MARK}]+|\n")
        self.memo: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str) -> Unigram:
        """Pieces of a SentencePiece model file, with log scores.

        The public table is a BPE one: its "scores" say in which order pieces were merged. A unigram model
        needs log probabilities, and tokenizers are not trained here; so a piece's rank r in that order is
        turned into one by Zipf's law, p = 1 / (r + 2.7) over the sum of these. A unigram table's own log
        scores are kept (they are no run of whole numbers).
        """
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        rows = []
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                rows.append((bytes([int(piece[3:5], 16)]), 0.0, "byte"))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                rows.append((b"", 0.0, "control"))
            else:
                rows.append((piece.encode(), p.get_score(i), "piece"))
        scores = sorted((s for _, s, kind in rows if kind == "piece"), reverse=True)
        if all(s == int(s) for s in scores):
            rank = {s: r for r, s in enumerate(scores)}
            norm = float(np.log(sum(1 / (r + 2.7) for r in range(len(rank)))))
            rows = [(b, -float(np.log(rank[s] + 2.7)) - norm if kind == "piece" else s, kind) for b, s, kind in rows]
        return cls(rows, p.unk_id())

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        parts = []
        for t in texts:
            parts.append(self.split.findall(" " + t) if t else [])
        own = set().union(*map(set, parts))
        new = own - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:  # most segments never come again; those of these texts that came before stay
            self.memo = {s: self.memo[s] for s in own - new}
        self.learn(list(new))
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, p)), np.int32) for p in parts]

    def learn(self, segments: list[str]) -> None:
        if MARK in segments:
            self.memo[MARK] = self.byte_ids[list(MARK.encode())].tobytes()
            segments = [s for s in segments if s != MARK]
        raw = [s.replace(" ", MARK).encode("utf-8", "replace") for s in segments]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        at = 0
        while at < len(order):
            longest = len(raw[order[at]])
            if longest > TOGETHER:
                self.memo[segments[order[at]]] = self.alone(raw[order[at]])
                at += 1
                continue
            to = at
            while to < len(order) and to - at < 4096 and len(raw[order[to]]) <= max(longest + 3, longest * 5 // 4):
                to += 1
            for i, ids in zip(order[at:to], self.together([raw[i] for i in order[at:to]])):
                self.memo[segments[i]] = ids
            at = to

    def together(self, words: list[bytes]) -> list[bytes]:
        """Viterbi for many words at once: one step for each start and length, over all words that get so far."""
        n, size = len(words), np.array([len(w) for w in words])
        width = int(size.max())
        # one row a position; the padding can only lead to positions behind a word's end
        m = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width).T.astype(np.int32)
        best, start, piece = np.full((width + 1, n), -np.inf), np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -2, np.int32)
        best[0] = 0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        lead = np.where(m < 0x80, 1, np.where(m < 0xE0, 2, np.where(m < 0xF0, 3, 4)))
        m += 1
        for i in range(width):
            live = np.flatnonzero((best[i] > -np.inf) & (size > i))
            if not len(live):
                continue
            rows, here, state, step = live, best[i][live], None, lead[i]
            one = np.zeros(n, bool)  # words with a piece for this single character
            for j in range(i, width):
                nxt = m[j][live] + (base[state] if state is not None else base[0])
                ok = np.flatnonzero(check[nxt] == (state if state is not None else 0))
                if not len(ok):
                    break
                live, state, here = live[ok], nxt[ok], here[ok]
                v = value[state]
                hit = np.flatnonzero(v >= 0)
                if len(hit):
                    r, ids = live[hit], v[hit]
                    score = here[hit] + self.scores[ids]
                    if j < i + 4:
                        one[r[step[r] == j + 1 - i]] = True
                    up = np.flatnonzero(score > best[j + 1][r])
                    r = r[up]
                    best[j + 1][r], start[j + 1][r], piece[j + 1][r] = score[up], i, ids[up]
            odd = rows[~one[rows]]
            if len(odd):
                to = np.minimum(i + step[odd], size[odd])
                score = best[i][odd] + self.least
                up = score > best[to, odd]
                r, to = odd[up], to[up]
                best[to, r], start[to, r], piece[to, r] = score[up], i, -1
        at, steps = size.copy(), []
        all_rows = np.arange(n)
        while (at > 0).any():
            steps.append(np.where(at > 0, piece[at, all_rows], -3))
            at = np.where(at > 0, start[at, all_rows], 0)
        ids = np.array(steps[::-1], np.int32).T.copy() if steps else np.empty((n, 0), np.int32)
        used = (ids != -3).sum(axis=1)
        plain = ~(ids == -1).any(axis=1)
        out, whole = [], ids.shape[1]
        for k in range(n):
            out.append(ids[k, whole - used[k] :].tobytes() if plain[k] else self.with_bytes(words[k], ids[k, whole - used[k] :]))
        return out

    def with_bytes(self, word: bytes, ids: np.ndarray) -> bytes:
        """Replace unknown characters by the pieces of their bytes."""
        out, at = [], 0
        for i in ids.tolist():
            if i >= 0:
                out.append(i)
                at += len(self.bytes[i])
            else:
                c = word[at]
                n = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4
                out += self.byte_ids[np.frombuffer(word[at : at + n], np.uint8)].tolist()
                at += n
        return np.array(out, np.int32).tobytes()

    def alone(self, word: bytes) -> bytes:
        """Viterbi for one long word."""
        n = len(word)
        best, start, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-2] * (n + 1)
        best[0] = 0.0
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        for i in range(n):
            here = best[i]
            if here == float("-inf"):
                continue
            c = word[i]
            one, alone = 1 if c < 0x80 else 2 if c < 0xE0 else 3 if c < 0xF0 else 4, False
            state, j = 0, i
            while j < n:
                nxt = base[state] + word[j] + 1
                if check[nxt] != state:
                    break
                state = nxt
                j += 1
                v = value[state]
                if v >= 0:
                    alone |= j - i == one
                    s = here + scores[v]
                    if s > best[j]:
                        best[j], start[j], piece[j] = s, i, int(v)
            if not alone:
                j = min(n, i + one)
                if here + self.least > best[j]:
                    best[j], start[j], piece[j] = here + self.least, i, -1
        ids, at = [], n
        while at:
            ids.append(piece[at])
            at = start[at]
        return self.with_bytes(word, np.array(ids[::-1], np.int32))

    def decode(self, ids) -> str:
        """Pieces joined, bytes assembled (bad UTF-8 becomes U+FFFD), marks turned to spaces, the first one dropped."""
        text = b"".join(map(self.plain.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


#: Texts of one step: enough to fill the vectors of together(), few enough to stay within some tens of MB.
STEP_CHARS = 1_000_000


def steps(batch: pa.RecordBatch):
    """Parts of a batch with about STEP_CHARS bytes of text, and their texts."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    step = np.cumsum(size, dtype=np.int64) // STEP_CHARS
    edges = [0, *(np.flatnonzero(step[1:] != step[:-1]) + 1).tolist(), len(size)] if len(size) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        part = batch.slice(lo, hi - lo)
        yield part, part.column("text").to_pylist()


def encoded(batches, model: Unigram, keep: list[str], roundtrip: bool):
    """For each step of some batches its columns ``keep``, n_tokens and ids, and with ``roundtrip`` whether these decode to the text."""
    for b in batches:
        for part, texts in steps(b):
            lists = model.encode(texts)
            sizes = np.array([len(x) for x in lists], np.int64)
            if sizes.sum() >= 2**31 - 1:
                raise ValueError("a text has more tokens than an Arrow array can hold")
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate(lists), pa.int32()))
            same = [pa.array([model.decode(x) == (t or "") for t, x in zip(texts, lists)], pa.bool_())] if roundtrip else []
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array(sizes), ids, *same], [*keep, "n_tokens", "ids", *["roundtrip"] * roundtrip])


def encode(docs: DataFrame, model: Unigram, digests: bool = False, roundtrip: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Add n_tokens and ids (array<int>) to ``docs`` (text; the columns ``keep``, or all, stay, these two are replaced).

    With ``roundtrip`` that column (decoded text equals the text) is added too; it is found in the same pass,
    so texts and ids aren't sent to Python again. With ``digests`` the table has doc_id, n_tokens, ids_md5 (of
    little-endian 32-bit ids), decoded_sha256 (of the decoded text) and roundtrip instead. A null or empty
    text has no tokens and decodes to the empty text, which counts as a round trip. Every row stands alone, so
    repeated rows give repeated results, and an empty table gives an empty one. A literal U+2581 goes by its
    bytes and comes back as itself. A task goes through its texts in steps, and holds what one step needs.
    """
    box = Shipped(docs.sparkSession, model)  # a few MB, as large as its vocabulary

    def digests_of(batches):
        model = box.get()
        for b in batches:
            for part, texts in steps(b):
                rows = []
                for t, ids in zip(texts, model.encode(texts)):
                    back = model.decode(ids)
                    rows.append((len(ids), hashlib.md5(ids.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
                n, md5, sha, same = map(list, zip(*rows))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(md5, pa.string()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids_md5", "decoded_sha256", "roundtrip"])

    if digests:
        return docs.select("doc_id", "text").mapInArrow(digests_of, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_md5 string, decoded_sha256 string, roundtrip boolean")
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("roundtrip", T.BooleanType())] * roundtrip]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in new}]
    schema = T.StructType([*[docs.schema[c] for c in keep], *new])
    return docs.select(*keep, *["text"] * ("text" not in keep)).mapInArrow(lambda batches: encoded(batches, box.get(), keep, roundtrip), schema)


def decode(tokens: DataFrame, model: Unigram) -> DataFrame:
    """Add decoded (string) to a table with ids array<int>; null ids give null."""
    box = Shipped(tokens.sparkSession, model)
    kept = tokens.drop("decoded")

    def run(batches):
        model = box.get()
        for b in batches:
            ids = b.column("ids")
            ends, flat = ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)
            text = [model.decode(flat[a:z]) if ok else None for a, z, ok in zip(ends, ends[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))
