"""Byte-level BPE as a lazily determinised transducer, and a streaming decoder.

A token sequence is the BPE result if every adjacent pair of it is. A state of the
transducer is the set of the still possible readings, each as (place in the trie of
tokens, last token, tokens not yet emitted); a move on a byte grows every reading, closes
at most one token (the one that follows its last token rightly) and emits the tokens that
all readings share. States and moves are made when first met, as integers in one table.
The first KEPT moves stay for good; later ones are let go together whenever there are as
many again, so memory is bounded and common moves are never made twice. Whether two tokens
may stand side by side is told from their merge trees: no merge across the border may
come before the merges that end the parts that meet there.

Decoding runs an automaton over UTF-8 bytes whose moves on whole tokens are kept; bytes
are passed on up to the last whole character, and bytes that are no UTF-8 pass through
unchanged and are counted. Null texts count as empty; rows with a null or repeated doc_id
are encoded like any other, and an empty table gives no rows.
"""
import base64
import hashlib
from array import array

from rayframe.llm.common import small_batches

KEPT, PIECES = 120_000, 200_000  # first moves kept for good, later moves and entries of a generation of pairs; the same of pieces
FOREVER = 1 << 60


def load_ranks(path):
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Kept(dict):
    """A dict of at most two generations of entries."""

    def __init__(self, most):
        super().__init__()
        self.old, self.most = {}, most

    def keep(self, key, value):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def find(self, key):
        """The entry, or None; one of the old generation comes over."""
        value = self.old.get(key)
        return value if value is None else self.keep(key, value)


class Transducer:
    def __init__(self, ranks):
        self.ranks = ranks
        # The trie of the tokens: node 0 is its root.
        self.kids, self.token = [{}], [-1]
        for t, rank in ranks.items():
            at = 0
            for b in t:
                to = self.kids[at].get(b)
                if to is None:
                    to = self.kids[at][b] = len(self.kids)
                    self.kids.append({})
                    self.token.append(-1)
                at = to
            self.token[at] = rank
        self.bytes = {v: k for k, v in ranks.items()}
        self.trees, self.pairs, self.pieces = {}, Kept(KEPT), Kept(PIECES)
        first = ((0, -1, ()),)
        self.states, self.numbers, self.moves = [first], {first: 0}, {}
        self.firm, self.young = None, []

    def _let_go(self):
        """Drops the moves, and the states they led to, that came after the first KEPT."""
        for key in self.young:
            del self.moves[key]
        for state in self.states[self.firm :]:
            del self.numbers[state]
        del self.states[self.firm :], self.young[:]

    def merge(self, piece):
        """Tokens of a piece by merging pairs, lowest rank first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], FOREVER), i) for i in range(len(parts) - 1))
            if rank == FOREVER:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _tree(self, token):
        """(left side, right side) of a token's merge tree: from the whole down to a byte, each as (bytes, rank of the merge that ends it).

        None if merging the token's bytes doesn't give the token.
        """
        got = self.trees.get(token, 0)
        if got != 0:
            return got
        text = self.bytes[token]
        if len(text) == 1:
            got = ([(text, FOREVER)], [(text, FOREVER)])
        else:
            parts, last = [text[i : i + 1] for i in range(len(text))], None
            while len(parts) > 1:
                rank, i = min((self.ranks.get(parts[i] + parts[i + 1], FOREVER), i) for i in range(len(parts) - 1))
                if rank == FOREVER:
                    break
                last = parts[i], parts[i + 1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            got = None
            if len(parts) == 1:
                a, b = (self._tree(self.ranks[x]) for x in last)
                if a and b:
                    got = ([(text, FOREVER), (last[0], token), *a[0][1:]], [(text, FOREVER), (last[1], token), *b[1][1:]])
        self.trees[token] = got
        return got

    def fits(self, last, token):
        """Whether merging the two tokens' bytes gives just these two (last -1: the token alone)."""
        own = self._tree(token)
        if own is None:
            return False
        if last < 0:
            return True
        key = last << 20 | token
        got = self.pairs.get(key)
        if got is None:
            got = self.pairs.find(key)
        if got is None:
            left, right = self._tree(last)[1], own[0]
            rank, got = self.ranks.get, True
            # At the border stands a part of each side; both change as merges go on, smallest parts first.
            i, j = len(left) - 1, len(right) - 1
            while True:
                (x, x_ends), (y, y_ends) = left[i], right[j]
                r = rank(x + y, FOREVER)
                # Of equal ranks the leftmost merge comes first: the one inside the left token, then the one across.
                if r < FOREVER and r < x_ends and r <= y_ends:
                    got = False
                    break
                if x_ends <= y_ends:
                    i -= 1
                else:
                    j -= 1
                if i < 0 or j < 0:
                    break
            self.pairs.keep(key, got)
        return got

    def _move(self, key):
        """(next state * 256, tokens emitted) of a move not in the table; key is state * 256 + byte."""
        byte, after, complete = key & 255, [], None
        for node, last, pending in self.states[key >> 8]:
            to = self.kids[node].get(byte)
            if to is None:
                continue
            u = self.token[to]
            if u >= 0 and complete is None and self.fits(last, u):
                complete = (0, u, (*pending, u))
            if self.kids[to]:
                after.append((to, last, pending))
        if complete is None:
            raise ValueError("no token ends here: the ranks lack a byte")
        after.append(complete)
        n, out = 0, after[0][2]
        while n < len(out) and all(len(x[2]) > n and x[2][n] == out[n] for x in after):
            n += 1
        if n:
            after = [(a, b, c[n:]) for a, b, c in after]
        state = tuple(after)
        number = self.numbers.get(state)
        if number is None:
            number = self.numbers[state] = len(self.states)
            self.states.append(state)
        got = self.moves[key] = number << 8, out[:n]
        if self.firm is not None:
            self.young.append(key)
        return got

    def encode_piece(self, piece):
        """Token ids of one piece's bytes."""
        u = self.ranks.get(piece)
        if u is not None:
            return (u,)
        if self.firm is None and len(self.moves) >= KEPT:
            self.firm = len(self.states)
        if len(self.young) >= KEPT:
            self._let_go()
        at, ids, get = 0, [], self.moves.get
        for b in piece:
            found = get(at + b)
            if found is None:
                found = self._move(at + b)
            at, out = found
            if out:
                ids += out
        ids += self.states[at >> 8][-1][2]
        return tuple(ids)

    def encode(self, text, pattern):
        """Ids of a text; a known piece's are kept as bytes."""
        ids, get, pieces = array("I"), self.pieces.get, self.pieces
        for piece in pattern.findall(text):
            got = get(piece)
            if got is None:
                got = pieces.find(piece)
                if got is None:
                    got = pieces.keep(piece, array("I", self.encode_piece(piece.encode())).tobytes())
            ids.frombytes(got)
        return ids


class Utf8:
    """States of an automaton over UTF-8 bytes: (bytes seen, bytes to come, least, greatest next byte); BAD after a byte that fits nowhere."""

    START, BAD = (0, 0, 0, 0), (0, 0, 1, 1)

    @classmethod
    def step(cls, state, b):
        seen, left, lo, hi = state
        if left:
            if lo <= b <= hi:
                return cls.START if left == 1 else (seen + 1, left - 1, 0x80, 0xBF)
            after = cls.step(cls.START, b)
            return cls.BAD if after == cls.START else after
        if b < 0x80:
            return cls.START
        # Well-formed lead bytes with the range of the byte after them.
        if 0xC2 <= b <= 0xDF:
            return (1, 1, 0x80, 0xBF)
        if 0xE0 <= b <= 0xEF:
            return (1, 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF)
        if 0xF0 <= b <= 0xF4:
            return (1, 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF)
        return cls.BAD


class StreamDecoder:
    """Feeds token ids through the automaton; gives bytes up to the last whole character, the rest waits.

    `bad` counts characters that a wrong byte broke off or that are none; a broken one is let go at once.
    """

    def __init__(self, by_id, moves=None):
        self.by_id, self.state, self.rest, self.bad = by_id, Utf8.START, b"", 0
        self.moves = {} if moves is None else moves

    def _token(self, state, token):
        """(state after a token, wrong bytes in it); moves that begin at a character are kept."""
        bad = 0
        for b in self.by_id[token]:
            before, state = state, Utf8.step(state, b)
            if state == Utf8.BAD:
                bad, state = bad + 1, Utf8.START
            elif before[1] and not (before[2] <= b <= before[3]):
                bad += 1
        return state, bad

    def feed(self, ids):
        state, bad, moves, start = self.state, 0, self.moves, Utf8.START
        for t in ids:
            found = moves.get(t) if state is start else None
            if found is None:
                found = self._token(state, t)
                if found[0] == start:
                    found = start, found[1]
                if state is start:
                    moves[t] = found
            state = found[0]
            bad += found[1]
        data = self.rest + b"".join(map(self.by_id.__getitem__, ids))
        cut = len(data) - state[0]
        self.state, self.rest, self.bad = state, data[cut:], self.bad + bad
        return data[:cut]

    def end(self):
        """The bytes that still wait; a character cut off at the end counts as bad."""
        out, self.rest = self.rest, b""
        self.bad += bool(out)
        self.state = Utf8.START
        return out


_OPEN = {}  # of this worker process: transducers and decoder moves by path of the ranks


def _opened(path):
    if path not in _OPEN:
        ranks = load_ranks(path)
        _OPEN[path] = Transducer(ranks), {v: k for k, v in ranks.items()}, {}
    return _OPEN[path]


def digests(docs, path, pattern_text):
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""

    def run(batches):
        import pandas as pd
        import regex

        fst, by_id, moves = _opened(path)
        pattern = regex.compile(pattern_text)
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf.doc_id, pdf.text):
                ids = fst.encode(text or "", pattern)
                stream, h = StreamDecoder(by_id, moves), hashlib.sha256()
                for i in range(0, len(ids), 4096):
                    h.update(stream.feed(ids[i : i + 4096]))
                h.update(stream.end())
                rows.append((doc, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), h.hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
