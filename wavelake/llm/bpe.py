"""Byte-level BPE encoding by a prefix-sharing trie, and decoding.

For merges applied in rank order, the encoding of a prefix is the encoding of a shorter prefix plus one last token, and that last
token is the only vocabulary entry that ends there and whose join to the token before it would survive the merges.  So every
node of a trie of words needs its last token only.  New words are put into the trie in order, so that words of one prefix stand
together and share its nodes; the nodes of one depth are computed at once, as arrays, and the encodings are read off by walking
back along the paths.  Words of more than LEVEL_BYTES bytes go depth first, one after another: the path to the word before is at
hand, the nodes of the shared prefix stand, and only those below them are computed.

Of the trie no more than MOST_NODES nodes stay beside the path itself.  Finished words are kept in two generations of at most
about MOST_WORDS words: when the younger is full it becomes the elder, and words met again come back.  The younger stays from task
to task; the elder goes at the end of a task, as idle workers keep what they hold.
Texts longer than PART_CHARS are cut and encoded STEP words at a time.

Edge cases: a null text is encoded as the empty one (no ids); added tokens in a text are single ids, as the library has it;
an empty table gives an empty result; other columns are kept (``ids`` and ``decoded`` replace columns of these names).
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache
from itertools import islice
from struct import pack

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

MOST_NODES = 300_000
MOST_WORDS = 100_000
#: Letters of the longest word that is kept, so that kept words are bounded in bytes too (about 30 MB).
KEPT_LENGTH = 64
MOST_PAIRS = 200_000
#: Bytes of the longest word that is computed by depth, and words computed together.
LEVEL_BYTES = 64
LEVEL_WORDS = 1 << 14
#: Slots for pairs of tokens already looked at.
PAIR_SLOTS = 1 << 20
#: Text (characters) encoded at a time, and ids that one Arrow batch of the output holds, about.
PART_CHARS = 1 << 20
STEP = 1 << 16
BATCH_IDS = 1 << 18


def _tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter of each byte in vocabulary files: printable Latin-1 as it is, the others counted up from code point 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TrieBPE:
    """Encoder and decoder of one byte-level BPE vocabulary."""

    def __init__(self, path: str):
        import regex

        spec = json.loads(open(path, encoding="utf-8").read())
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        # order: bytes first, then merged tokens in the order of their merges
        self.order = {i: i - (1 << 30) for i in self.bytes_of}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.merged[left, right] = rank
            self.parts[made] = (left, right)
            self.order[made] = rank
        self._automaton()
        self._arrays()
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.size = array("i", [0] * (max(self.bytes_of, default=0) + 1))
        for i, raw in self.bytes_of.items():
            self.size[i] = len(raw)
        self.bytes_of |= {i: t.encode() for t, i in added.items()}
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        # Fixed value: the pattern by which byte-level BPE cuts a text; white space as Unicode defines it.
        pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
        self.cut, self.cuts = pattern.findall, pattern.finditer
        self.pairs: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.long: list[str] = []
        self._clear()

    def _automaton(self) -> None:
        """States are the beginnings of tokens; ``ends`` has, for each, the tokens that end there (token, length), long ones first."""
        step: dict[int, int] = {}
        token_at, parents = {}, [(0, 0)]
        for raw, token in self.id_of.items():
            state = 0
            for byte in raw:
                nxt = step.get(state << 8 | byte)
                if nxt is None:
                    nxt = step[state << 8 | byte] = len(parents)
                    parents.append((state, byte))
                state = nxt
            token_at[state] = (token, len(raw))
        depth = [0] * len(parents)
        for k in range(1, len(parents)):
            depth[k] = depth[parents[k][0]] + 1
        fall, ends = [0] * len(parents), [()] * len(parents)
        self.step, self.fall, self.ends = step, fall, ends
        for k in sorted(range(1, len(parents)), key=depth.__getitem__):
            above, byte = parents[k]
            fall[k] = self._advance(fall[above], byte) if above else 0
            own = (token_at[k],) if k in token_at else ()
            ends[k] = own + ends[fall[k]]

    def _arrays(self) -> None:
        """The same tables as arrays, for many nodes at a time."""
        edges = np.array(sorted(self.step.items()), np.int32).reshape(-1, 2)
        self.edge, self.edge_to = np.ascontiguousarray(edges[:, 0]), np.ascontiguousarray(edges[:, 1])
        self.falls = np.array(self.fall, np.int32)
        self.end_at = np.cumsum([0, *map(len, self.ends)]).astype(np.int32)
        flat = np.array([e for some in self.ends for e in some], np.int32).reshape(-1, 2)
        self.end_token, self.end_size = np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])
        n = max(self.bytes_of, default=0) + 1
        self.orders, self.lefts, self.rights = np.zeros(n, np.int64), np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        for i, x in self.order.items():
            self.orders[i] = x
        for i, (a, b) in self.parts.items():
            self.lefts[i], self.rights[i] = a, b
        merges = np.array(sorted((a << 32 | b, rank) for (a, b), rank in self.merged.items()), np.int64).reshape(-1, 2)
        self.merge, self.merge_rank = np.ascontiguousarray(merges[:, 0]), np.ascontiguousarray(merges[:, 1])
        self.seen = np.full(PAIR_SLOTS, -1, np.int64)
        # made again for the first word that is too long to be computed by depth
        self.step, self.fall, self.ends = {}, [], []

    def _advance_all(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        out, act, state = np.zeros(len(state), np.int32), np.arange(len(state)), state.astype(np.int32)
        while act.size:
            key = state << 8 | byte
            at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[at] == key
            out[act[hit]] = self.edge_to[at[hit]]
            more = ~hit & (state > 0)
            act, state, byte = act[more], self.falls[state[more]], byte[more]
        return out

    def _stand(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``stands`` for many pairs; what is found is kept in PAIR_SLOTS slots."""
        pair = a.astype(np.int64) << 32 | b
        slot = (C.mix64(pair.view(np.uint64)) & np.uint64(PAIR_SLOTS - 1)).astype(np.int64)
        held = self.seen[slot]
        ok = (held & 1).astype(bool)
        new = np.nonzero(held >> 1 != pair)[0]
        if new.size:
            ok[new] = self._look(a[new], b[new])
            self.seen[slot[new]] = pair[new] << 1 | ok[new]
        return ok

    def _look(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok, act, before = np.ones(len(x), bool), np.arange(len(x)), np.full(len(x), 1 << 40)
        while act.size:
            key = x.astype(np.int64) << 32 | y
            at = np.minimum(np.searchsorted(self.merge, key), len(self.merge) - 1)
            joins = (self.merge[at] == key) & (self.merge_rank[at] < before)
            ok[act[joins]] = False
            later_x = self.orders[x] > self.orders[y]
            whole = np.where(later_x, x, y)
            more = ~joins & (self.lefts[whole] >= 0)
            before = (self.orders[whole] + ~later_x)[more]
            x, y = np.where(later_x, self.rights[x], x)[more], np.where(later_x, y, self.lefts[y])[more]
            act = act[more]
        return ok

    def _advance(self, state: int, byte: int) -> int:
        step = self.step
        while True:
            nxt = step.get(state << 8 | byte)
            if nxt is not None:
                return nxt
            if not state:
                return 0
            state = self.fall[state]

    def _clear(self) -> None:
        """The trie as its root: the last token of each node; the nodes on the path to the word before, and their states."""
        self.last = array("i", [-1])
        self.path = array("i", [0])
        self.states = array("i", [0])
        self.word = b""

    def stands(self, a: int, b: int) -> bool:
        """Whether tokens a and b next to each other stay apart: no merge across their border comes first while they are built.

        Walks back in time, always undoing the later of the two tokens at the border.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, before, ok = a, b, 1 << 40, True
        while True:
            rank = self.merged.get((x, y))
            if rank is not None and rank < before:
                ok = False
                break
            later_x = self.order[x] > self.order[y]
            whole = x if later_x else y
            if whole not in self.parts:
                break
            # of equal merges the left one comes first, so a merge of y's own rank across the border would beat y
            before = self.order[whole] + (not later_x)
            if later_x:
                x = self.parts[x][1]
            else:
                y = self.parts[y][0]
        if len(self.pairs) >= MOST_PAIRS:
            self.pairs.clear()
        self.pairs[a, b] = ok
        return ok

    def _follow(self, word: bytes) -> bytes:
        """Ids of ``word``; nodes below the prefix that it shares with the word before get their last token."""
        if not self.ends:
            self._automaton()
        last, path, states, pairs, step, ends = self.last, self.path, self.states, self.pairs, self.step, self.ends
        prev, shared = self.word, 0
        most = min(len(prev), len(word))
        if prev[:most] == word[:most]:
            shared = most
        else:
            while prev[shared] == word[shared]:
                shared += 1
        del path[shared + 1 :], states[shared + 1 :]
        if len(last) > MOST_NODES:
            kept = array("i", (last[k] for k in path))
            last[:] = kept
            path[:] = array("i", range(len(kept)))
        state = states[shared]
        for end in range(shared + 1, len(word) + 1):
            byte = word[end - 1]
            nxt = step.get(state << 8 | byte)
            state = self._advance(state, byte) if nxt is None else nxt
            for token, length in ends[state]:
                if length == end:
                    break
                before = last[path[end - length]]
                ok = pairs.get((before, token))
                if ok or ok is None and self.stands(before, token):
                    break
            else:
                raise ValueError(f"no token ends at byte {end} of a word")
            path.append(len(last))
            last.append(token)
            states.append(state)
        self.word = word
        ids, size, end = array("i"), self.size, len(word)
        while end:
            token = last[path[end]]
            ids.append(token)
            end -= size[token]
        ids.reverse()
        return ids.tobytes()

    def _levels(self, words: list[bytes]) -> list[bytes]:
        """Ids of sorted words, none empty: the nodes of each depth at once."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        n, deep = len(words), int(size.max())
        letters = np.array(words, f"S{deep}").view(np.uint8).reshape(n, deep)
        differ = letters[1:] != letters[:-1]
        shared = np.zeros(n, np.int64)
        shared[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), deep), np.minimum(size[1:], size[:-1]))
        last, state, nodes = np.zeros((deep + 1, n), np.int32), np.zeros(n, np.int32), [np.array([-1], np.int32)]
        for depth in range(deep):
            rows = np.nonzero(size > depth)[0]
            fresh = shared[rows] <= depth
            new = rows[fresh]
            to = self._advance_all(state[new], letters[new, depth])
            token, at, act = np.zeros(len(new), np.int32), self.end_at[to], np.arange(len(new))
            while act.size:
                k = at[act]
                if (k >= self.end_at[to[act] + 1]).any():
                    raise ValueError(f"no token ends at byte {depth + 1} of a word")
                t, start = self.end_token[k], depth + 1 - self.end_size[k]
                ok = start == 0
                rest = np.nonzero(~ok)[0]
                ok[rest] = self._stand(last[start[rest], new[act[rest]]], t[rest])
                token[act[ok]] = t[ok]
                act = act[~ok]
                at[act] += 1
            of = np.cumsum(fresh) - 1
            last[depth + 1, rows], state[rows] = token[of], to[of]
            nodes.append(token)
        self._clear()
        self.last = array("i", np.concatenate(nodes).tobytes())
        sizes, found, act, end = np.frombuffer(self.size, np.int32), [], np.arange(n), size.copy()
        steps = np.zeros(n, np.int64)
        while act.size:
            token = last[end[act], act]
            found.append((act, token))
            steps[act] += 1
            end[act] -= sizes[token]
            act = act[end[act] > 0]
        ends = np.cumsum(steps)
        ids = np.zeros(int(ends[-1]), "<i4")
        for back, (who, token) in enumerate(found):
            ids[ends[who] - 1 - back] = token
        raw, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _blocks(self, words: list[bytes]):
        """Index ranges of words that are computed together."""
        at, held = 0, 0
        for i, w in enumerate(words):
            if i > at and (held + len(w) > MOST_NODES or i - at >= LEVEL_WORDS):
                yield at, i
                at, held = i, 0
            held += len(w)
        if at < len(words):
            yield at, len(words)

    def learn(self, words) -> None:
        """Encode words not yet known, in sorted order: depth first through the trie."""
        words = set(words)
        new = words.difference(self.words)
        if not new:
            return
        if len(self.words) + len(new) > MOST_WORDS:
            self.elder, self.words = self.words, {}
            new = words
        known, elder = self.words, self.elder
        for w in (back := new.intersection(elder) if elder else ()):
            known[w] = elder[w]
        ordered = sorted(new.difference(back))  # code points sort as their bytes do
        raw = [w.encode() for w in ordered]
        short = [k for k, w in enumerate(raw) if len(w) <= LEVEL_BYTES]
        some = [raw[k] for k in short]
        for a, b in self._blocks(some):
            known.update(zip((ordered[k] for k in short[a:b]), self._levels(some[a:b]), strict=True))
        if len(short) < len(raw):
            for w, x in zip(ordered, raw, strict=True):
                if len(x) > LEVEL_BYTES:
                    known[w] = self._follow(x)
        self.long += [w for w in new if len(w) > KEPT_LENGTH]

    def rest(self) -> None:
        """What an idle worker need not hold goes."""
        self.elder = {}
        C.give_back()

    def _forget(self) -> None:
        """Long words go once the texts that hold them are done."""
        for w in self.long:
            self.words.pop(w, None)
            self.elder.pop(w, None)
        self.long.clear()

    def pieces(self, text: str) -> list[tuple[bool, str]]:
        """A text cut at added tokens: (is one, piece)."""
        if self.at_added and self.at_added.search(text):
            return [(k % 2 == 1, p) for k, p in enumerate(self.at_added.split(text))]
        return [(False, text)]

    def _encode_long(self, piece: str) -> bytes:
        words, out = (m.group() for m in self.cuts(piece)), []
        while some := list(islice(words, STEP)):
            self.learn(some)
            out.append(b"".join(map(self.words.__getitem__, some)))
            self._forget()
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; words of all texts go through the trie together."""
        cut = [[pack("<i", self.added[p]) if one else self._encode_long(p) if len(p) > PART_CHARS else self.cut(p) for one, p in self.pieces(t)] for t in texts]
        self.learn(set().union(*(p for pieces in cut for p in pieces if not isinstance(p, bytes))))
        known = self.words.__getitem__
        out = [b"".join(p if isinstance(p, bytes) else b"".join(map(known, p)) for p in pieces) for pieces in cut]
        self._forget()
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<i4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def trie_bpe(path: str) -> TrieBPE:
    return TrieBPE(path)


def _lists(held: list[bytes]):
    import pyarrow as pa

    sizes = np.array([0, *map(len, held)]) // 4
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(np.frombuffer(b"".join(held), "<i4")))


def _parts(values, most: int):
    """Slices of a string array with about ``most`` characters, so that no batch is a list of Python texts as a whole."""
    at = 0
    while at < len(values):
        texts, size = [], 0
        while at < len(values) and size < most:
            texts.append(values[at].as_py() or "")
            size += len(texts[-1])
            at += 1
        yield texts


def encode(df: DataFrame, text_col: str = "text", path: str | None = None, decoded: bool = False, drop: tuple = ()) -> DataFrame:
    """``df`` with ``ids`` (array of int) of the whole text; ``decoded``: also what these ids decode to, in the same pass; ``drop``: columns not passed on."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

    C.text_batches(df.sparkSession)
    path = path or _tokenizer_path("byte_bpe_50k.json")
    held = [c for c in df.columns if c not in drop and c != "ids" and not (decoded and c == "decoded")]
    schema = StructType([df.schema[c] for c in held]).add("ids", ArrayType(IntegerType()))
    if decoded:
        schema = schema.add("decoded", StringType())

    def op(batches):
        bpe = trie_bpe(path)
        for batch in batches:
            at = 0
            for texts in _parts(batch.column(batch.num_columns - 1), PART_CHARS):
                ids = bpe.encode_all(texts)
                cols = [batch.column(k).slice(at, len(ids)) for k in range(batch.num_columns - 1)]
                made = [_lists(ids)]
                if decoded:
                    made.append(pa.array([bpe.decode(np.frombuffer(x, "<i4").tolist()) for x in ids], pa.string()))
                yield pa.record_batch([*cols, *made], names=[*held, *schema.names[len(held) :]])
                at += len(ids)
            del batch
        bpe.rest()

    return df.select(*held, F.col(text_col).cast("string").alias("__wl_in")).mapInArrow(op, schema)


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with ``decoded``, the text of the ids (null for null)."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructType

    path = path or _tokenizer_path("byte_bpe_50k.json")
    held = [c for c in df.columns if c != "decoded"]
    schema = StructType([df.schema[c] for c in held]).add("decoded", StringType())

    def op(batches):
        bpe = trie_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if v is None else bpe.decode(v) for v in part.column(part.num_columns - 1).to_pylist()]
                yield pa.record_batch([*[part.column(k) for k in range(part.num_columns - 1)], pa.array(texts, pa.string())], names=[*held, "decoded"])
            del batch
        bpe.rest()

    return df.select(*held, F.col(ids_col).alias("__wl_in")).mapInArrow(op, schema)


def digests(encoded: DataFrame) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256")
    )


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode(docs, decoded=True, drop=("text",)))
