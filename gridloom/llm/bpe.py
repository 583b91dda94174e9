"""Byte-level BPE encoding and decoding as finite-state transducers (operator 4).

Encoding. A token sequence is the BPE encoding of its bytes exactly when every
two neighbours are the encoding of their own concatenation, and every prefix of
a text has exactly one such sequence. Reading bytes, a nondeterministic machine
therefore guesses where tokens end: a hypothesis is (tokens not yet emitted, the
token before the one being read, the node reached in the trie of the
vocabulary); at most one hypothesis stands at each of the last few byte
boundaries, so their number is bounded by the longest token. The machine is
determinised lazily: a state is the set of live hypotheses, transitions are
worked out when first taken, and what all hypotheses have in common is emitted.
The lookahead is bounded by the longest token. Neighbours are tested by undoing
merges along the boundary, from the merges that the ranks imply.

Decoding. A state machine over UTF-8 takes one token at a time and gives out
whole code points; its transitions (state, token) are compiled lazily too. It
can stop and go on at any token, and holds three pending bytes at most.

Tables are compiled once in each Python worker. Kept states and neighbour tests are
bounded by number and kept pieces by bytes, and all are forgotten when a task ends;
that costs time but never changes a result.

Defined cases: null and empty texts have no tokens; a text of any length is coded
whole; repeated rows are coded each; a null id stays null; an empty table gives no
rows; columns beside the id and the text are ignored, whatever their names. A piece that is a token as a whole
is that token, as in the tiktoken library.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm import textbytes

MAX_STATES, MAX_FITS, MAX_MOVES, MAX_HELD = 20_000, 200_000, 50_000, 64 << 20


_WIDE = 20  # bits of a token number within a key


class Transducer:
    """The lazily determinised encoder of a ranked byte vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self._compile()
        self.reset()

    def _compile(self) -> None:
        """The last merge of each token, and the trie of those that merging can reach."""
        top = max(self.bytes_of, default=-1) + 1
        self._left, self._right = [-1] * top, [-1] * top
        self._merged: dict[int, int] = {}
        self._edge: dict[int, int] = {}  # (node, byte) -> node
        self._token_at: list[int] = [-1]
        self._inner: list[bool] = [False]
        for token, rank in self.ranks.items():
            if len(token) > 1:
                halves = self._last_merge(token, rank)
                if halves is None:
                    continue
                self._left[rank], self._right[rank] = halves
                self._merged[halves[0] << _WIDE | halves[1]] = rank
            node = 0
            for byte in token:
                after = self._edge.get(node << 8 | byte)
                if after is None:
                    after = self._edge[node << 8 | byte] = len(self._token_at)
                    self._inner[node] = True
                    self._token_at.append(-1)
                    self._inner.append(False)
                node = after
            self._token_at[node] = rank

    def _last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        get, parts = self.ranks.get, [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = get(parts[k] + parts[k + 1])
                if r is not None and r < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if all(p in self.ranks for p in parts) else None

    def _walk(self, a: int, b: int) -> bool:
        """Whether merging the bytes of the two tokens gives these two tokens again.

        Goes back in time along the boundary: the later of the two merges beside it is
        undone first. A merge across the boundary that would have come before the
        merges undone so far is a contradiction; of equal merges the left one is first.
        """
        left, right, merged = self._left, self._right, self._merged
        until, strict = 1 << 60, True
        while True:
            across = merged.get(a << _WIDE | b)
            if across is not None and (across < until or across == until and not strict):
                return False
            x, y = right[a], left[b]
            if x < 0 and y < 0:
                return True
            if y < 0 or x >= 0 and a > b:
                until, strict, a = a, True, x
            else:
                until, strict, b = b, False, y

    def reset(self) -> None:
        """Forget all states but the start, which is number 0, and all neighbour tests."""
        self._fit: dict[int, bool] = {}  # (token, token) -> whether they may be neighbours
        self._hypotheses = []
        self._number: dict[tuple, int] = {}
        self._move: dict[int, int] = {}  # (state, byte) -> state
        self._emit: dict[int, tuple[int, ...]] = {}  # (state, byte) -> tokens, where any
        self._final: list[tuple[int, ...]] = []
        self._state((((), -1, 0),))

    def _state(self, target: tuple) -> int:
        number = self._number.get(target)
        if number is None:
            number = self._number[target] = len(self._hypotheses)
            self._hypotheses.append(target)
            self._final.append(next((out for out, _, node in target if node == 0), ()))
        return number

    def _step(self, state: int, byte: int) -> int:
        edge, token_at, inner, fit, live = self._edge, self._token_at, self._inner, self._fit, []
        for out, last, node in self._hypotheses[state]:
            after = edge.get(node << 8 | byte)
            if after is None:
                continue
            token = token_at[after]
            if token >= 0:
                if last < 0:
                    good = True
                else:
                    good = fit.get(last << _WIDE | token)
                    if good is None:
                        if len(fit) >= MAX_FITS:
                            fit.clear()
                        good = fit[last << _WIDE | token] = self._walk(last, token)
                if good:
                    live.append(((*out, token), token, 0))
            if inner[after]:
                live.append((out, last, after))
        shared = live[0][0]
        for out, _, _ in live:
            if not shared:
                break
            if out[: len(shared)] != shared:
                k = 0
                while k < len(shared) and k < len(out) and shared[k] == out[k]:
                    k += 1
                shared = shared[:k]
        cut = len(shared)
        if cut:
            live = [(out[cut:], last, node) for out, last, node in live]
            self._emit[state << 8 | byte] = shared
        number = self._state(tuple(live))
        self._move[state << 8 | byte] = number
        return number

    def _undetermined(self, live: list, byte: int) -> list:
        """One step of the nondeterministic machine; outputs are chains (chain before, token)."""
        edge, token_at, inner, fit, after = self._edge, self._token_at, self._inner, self._fit, []
        for out, last, node in live:
            to = edge.get(node << 8 | byte)
            if to is None:
                continue
            token = token_at[to]
            if token >= 0:
                good = True if last < 0 else fit.get(last << _WIDE | token)
                if good is None:
                    if len(fit) >= MAX_FITS:
                        fit.clear()
                    good = fit[last << _WIDE | token] = self._walk(last, token)
                if good:
                    after.append(((out, token), token, 0))
            if inner[to]:
                after.append((out, last, to))
        return after

    def encode_pieces(self, pieces) -> list[tuple[bytes, list[int]]]:
        """The tokens of each distinct piece. Pieces are taken in order, each from the
        states that its prefix shared with the piece before it led to. While fewer than
        ``MAX_STATES`` states are known new ones are determinised and kept; past that
        number only known transitions are taken, and where they end the machine goes on
        nondeterministically for the rest of the piece."""
        done, whole = [], self.ranks.get
        move, emit, hypotheses = self._move.get, self._emit.get, self._hypotheses
        before, states, counts, out, lives = b"", [0], [0], [], []
        for piece in sorted(pieces):
            token = whole(piece)
            if token is not None:
                done.append((piece, [token]))
                continue
            k, most = 0, min(len(before), len(piece))
            while k < most and before[k] == piece[k]:
                k += 1
            before = piece
            fixed = min(k, len(states) - 1)
            del states[fixed + 1 :], counts[fixed + 1 :], lives[max(0, k - fixed) :]
            if not lives:
                state = states[fixed]
                del out[counts[fixed] :]
                while fixed < len(piece):
                    byte = piece[fixed]
                    after = move(state << 8 | byte)
                    if after is None:
                        if len(hypotheses) >= MAX_STATES:
                            break
                        after = self._step(state, byte)
                    made = emit(state << 8 | byte)
                    if made is not None:
                        out += made
                    state = after
                    states.append(state)
                    counts.append(len(out))
                    fixed += 1
                if fixed == len(piece):
                    done.append((piece, [*out, *self._final[state]]))
                    continue
                live = []
                for pending, last, node in hypotheses[state]:
                    chain = None
                    for token in pending:
                        chain = (chain, token)
                    live.append((chain, last, node))
                k = fixed
            else:
                live = lives[-1]
            for byte in piece[k:]:
                live = self._undetermined(live, byte)
                lives.append(live)
            chain = next(out_ for out_, _, node in live if node == 0)
            rest = []
            while chain is not None:
                chain, token = chain
                rest.append(token)
            done.append((piece, [*out, *reversed(rest)]))
        return done


_BAD = -1


def _utf8_step(state: tuple[int, int, int], byte: int):
    """(bytes still to come, least and greatest next byte) after ``byte``, or ``_BAD``."""
    todo, low, high = state
    if todo:
        return (todo - 1, 0x80, 0xBF) if low <= byte <= high else _BAD
    if byte < 0x80:
        return (0, 0x80, 0xBF)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return _BAD


class StreamDecoder:
    """Tokens in, whole code points out; ill-formed bytes give U+FFFD as in Unicode's best practice."""

    START = ((0, 0x80, 0xBF), b"")

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of = bytes_of
        self._moves: dict[tuple, tuple[tuple, str]] = {}

    def forget(self) -> None:
        self._moves.clear()

    def move(self, state: tuple, token: int) -> tuple[tuple, str]:
        known = self._moves.get((state, token))
        if known is not None:
            return known
        (machine, held), out, begun = state, [], bytearray(state[1])
        del held
        for byte in self.bytes_of[token]:
            after = _utf8_step(machine, byte)
            if after == _BAD and machine[0]:
                out.append("�")
                begun.clear()
                machine = self.START[0]
                after = _utf8_step(machine, byte)
            if after == _BAD:
                out.append("�")
                machine = self.START[0]
                continue
            begun.append(byte)
            machine = after
            if not machine[0]:
                out.append(begun.decode("utf-8"))
                begun.clear()
        result = ((machine, bytes(begun)), "".join(out))
        if len(self._moves) >= MAX_MOVES:
            self._moves.clear()
        self._moves[(state, token)] = result
        return result

    def decode(self, tokens) -> str:
        state, out = self.START, []
        for token in tokens:
            state, text = self.move(state, token)
            out.append(text)
        if state[1]:
            out.append("\ufffd")
        return "".join(out)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder with a bounded memory of pieces already met."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.machine = Transducer(ranks)
        self.decoder = StreamDecoder(self.machine.bytes_of)
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.held = 0  # bytes of ``known``, about
        # The decoder's transitions from its start to its start: tokens of whole code points.
        self.closed: dict[str, str] = {}
        for token in self.machine.bytes_of:
            state, text = self.decoder.move(StreamDecoder.START, token)
            if state == StreamDecoder.START:
                self.closed[str(token)] = text
        self.decoder.forget()

    def forget(self) -> None:
        """Back to the compiled tables."""
        self.machine.reset()
        self.decoder.forget()
        self.known, self.old, self.held = {}, {}, 0

    def encode(self, texts: list[str]) -> list[str]:
        """Each text's ids as decimal numbers joined by spaces."""
        cut = [self.pieces(text) for text in texts]
        if self.held > MAX_HELD // 2:  # the older half goes; what is met again is taken over
            self.old, self.known, self.held = self.known, {}, 0
        known, old = self.known, self.old
        new = set().union(*cut) - known.keys()
        again = new & old.keys()
        for piece in again:
            ids = known[piece] = old[piece]
            self.held += 200 + len(piece) + len(ids)
        new -= again
        for piece, tokens in self.machine.encode_pieces([piece.encode("utf-8") for piece in new]):
            ids = known[piece.decode("utf-8")] = " ".join(map(str, tokens))
            self.held += 200 + len(piece) + len(ids)
        ids_of = known.__getitem__
        return [" ".join(map(ids_of, pieces)) for pieces in cut]

    def decode(self, ids: str) -> str:
        """The text of ids written as by :meth:`encode`; tokens that split code points take the machine's other states."""
        if not ids:
            return ""
        tokens = ids.split(" ")
        texts = list(map(self.closed.get, tokens))
        k = 0
        while True:
            try:
                k = texts.index(None, k)
            except ValueError:
                break
            state = StreamDecoder.START
            while k < len(texts):
                state, texts[k] = self.decoder.move(state, int(tokens[k]))
                k += 1
                if state == StreamDecoder.START:
                    break
            if state[1]:
                texts.append("\ufffd")
                break
        return "".join(texts)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(read_ranks(path), pattern)


def _coding(path: str, pattern: str, work):
    """``work(codec, batches)``; what the codec has learnt is forgotten at the end of the task."""

    def run(batches):
        coder = codec(path, pattern)
        try:
            yield from work(coder, batches)
        finally:
            coder.forget()

    return textbytes.lean(run)


def _batches(ids, texts, chars: int = 1 << 20):
    """Rows in runs of about ``chars`` characters; a longer text is a run of its own."""
    row, held, size = 0, [], 0
    for k in range(len(texts)):
        text = texts[k].as_py() or ""
        held.append(text)
        size += len(text)
        if size >= chars or k + 1 == len(texts):
            yield ids.slice(row, k + 1 - row), held
            row, held, size = k + 1, [], 0


def _token_rows(coder: Codec, batches):
    for batch in batches:
        for ids, texts in _batches(batch.column(0), batch.column(1)):
            tokens = [[int(i) for i in made.split(" ")] if made else [] for made in coder.encode(texts)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(tokens, pa.list_(pa.int32()))], names=["doc_id", "tokens"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, tokens) of every row of ``docs(doc_id, text)``."""
    return docs.select("doc_id", "text").mapInArrow(_coding(path, pattern, _token_rows), "doc_id long, tokens array<int>")


def _text_rows(coder: Codec, batches):
    for batch in batches:
        for k in range(0, len(batch), 256):
            texts = [None if row is None else coder.decoder.decode(row) for row in batch.column(1).slice(k, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of every row of ``tokens(doc_id, tokens)``; null tokens give null."""
    return tokens.select("doc_id", "tokens").mapInArrow(_coding(path, pattern, _text_rows), "doc_id long, text string")


def _digest_rows(coder: Codec, batches):
    for batch in batches:
        for ids, texts in _batches(batch.column(0), batch.column(1)):
            made = coder.encode(texts)
            n = [m.count(" ") + 1 if m else 0 for m in made]
            of_ids = [hashlib.sha256(m.encode()).hexdigest() for m in made]
            of_texts = [hashlib.sha256(coder.decode(m).encode("utf-8")).hexdigest() for m in made]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what :func:`encode` and then :func:`decode` give, as digests."""
    return docs.select("doc_id", "text").mapInArrow(_coding(path, pattern, _digest_rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
