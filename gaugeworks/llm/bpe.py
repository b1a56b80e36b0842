"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a pretoken there is exactly one token that can end its
encoding. `extend` stores that token for each prefix: a token t ending at i is
the one if the token before it, last[i - len(t)], may stand next to t, that is
if merging their joined bytes gives the two back. Reading the table backwards
gives the encoding. Appending bytes only extends the table; after an edit the
table is recomputed until it agrees with the old one over a longest token's
length, from where on the old entries hold.

Defined cases: a null text is empty; an empty text has no tokens; every other
text, however long, is encoded whole; repeated rows give repeated rows, also of
one id; further columns are not read; an empty table gives no rows. The pieces
of texts are memoised with their ids and the bytes decoded from these: the
memo has two generations of about `memo_size` pieces, and what the younger one
lacks comes from the older one or is encoded, all new pieces of a batch at once.
After a task the memo is given up, and which tokens fit is kept in a packed form.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import released

#: Unicode White_Space, as the pretoken pattern's \s takes it.
SPACES = "\t-\r \x85\xa0  -     　"
#: First character of a memo key that stands for the rest of itself alone; no piece behind one space begins with it.
ALONE = " "
#: A piece of more characters than that is split into pretokens by itself.
LONG = 1000
PIECES = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


NEVER = 1 << 60


class BytePairs:
    """Encoder of single pretokens. Tables hold ranks; -1 stands before the first token.

    States are the longest ends of what was read that begin a token; those met are kept, with the tokens that end there.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.base = max(ranks.values()) + 2
        self.size = [0] * self.base  # the last is of rank -1
        for t, i in ranks.items():
            self.size[i] = len(t)
        self.begins = {t[:n] for t in ranks for n in range(1, len(t) + 1)}
        self.fits: dict[int, bool] = {}
        self.packed = None
        self.sleep()

    def sleep(self) -> None:
        """Give up what was found out so far, but for which tokens fit, in a packed form: small objects that stay keep large blocks of memory from being freed."""
        if self.fits:
            self.packed = np.fromiter(self.fits.keys(), np.int64), np.fromiter(self.fits.values(), bool)
        self.fits, self.parts = {}, {}
        self.state, self.read_so_far, self.ending, self.next = {b"": 0}, [b""], [()], {}

    def wake(self) -> None:
        if self.packed and not self.fits:
            self.fits = dict(zip(*(x.tolist() for x in self.packed)))

    def step(self, state: int, byte: int) -> int:
        """The state after `byte`."""
        end = self.read_so_far[state] + bytes([byte])
        while end and end not in self.begins:
            end = end[1:]
        if end not in self.state:
            self.state[end] = len(self.ending)
            self.read_so_far.append(end)
            some = (end[i:] for i in range(len(end)))
            self.ending.append(tuple((self.ranks[t], len(t)) for t in some if t in self.ranks and self.reachable(t)))  # longest first
        if len(self.next) > 500_000:
            self.next.clear()
        to = self.next[state << 8 | byte] = self.state[end]
        return to

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts of the last merge that makes `token`; None if merging its bytes doesn't give it."""
        if token not in self.parts:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                best, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[token] = tuple(parts) if len(parts) == 2 else None
        return self.parts[token]

    def reachable(self, token: bytes) -> bool:
        return len(token) == 1 or self.split(token) is not None

    def fit(self, left: bytes, right: bytes) -> bool:
        """Whether merging the joined bytes gives the two back: undo the merges beside the seam, the latest first;
        no pair that ever met at the seam may have a merge due before its parts were merged away."""
        ranks, before_left, before_right = self.ranks, NEVER, NEVER
        while True:
            met = ranks.get(left + right, NEVER)
            if met < before_left and met <= before_right and met != NEVER:
                return False
            made_left = ranks[left] if len(left) > 1 else -1
            made_right = ranks[right] if len(right) > 1 else -1
            if made_left > made_right:
                before_left, left = made_left, self.split(left)[1]
            elif made_right >= 0:
                before_right, right = made_right, self.split(right)[0]
            else:
                return True

    def new_pair(self, left: int, token: int) -> bool:
        if len(self.fits) > 200_000:
            self.fits.clear()
        good = left < 0 or self.fit(self.tokens[left], self.tokens[token])
        self.fits[left * self.base + token] = good
        return good

    def extend(self, data: bytes, last: list[int], states: list[int] | None = None) -> list[int]:
        """last[i]: the token that ends the encoding of data[:i]; last[0] is -1. Goes on from len(last).

        states: the state after each prefix, for as many as `last` has; found again where not given.
        """
        if not last:
            last.append(-1)
        done = len(last) - 1
        onward, known, base, ending = self.next.get, self.fits.get, self.base, self.ending
        if states is None:
            states = [0]
            for b in data[max(0, done - self.longest) : done]:
                states.append(self.step(states[-1], b))
        elif not states:
            states.append(0)
        state = states[-1]
        for b in data[done:]:
            to = onward(state << 8 | b)
            state = self.step(state, b) if to is None else to
            states.append(state)
            for token, n in ending[state]:
                left = last[-n]
                good = known(left * base + token)
                if good or good is None and self.new_pair(left, token):
                    last.append(token)
                    break
            else:
                raise ValueError(f"no token ends at byte {len(last)}")
        return last

    def edit(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int]]:
        """Replace data[start:end] by `new`; returns the new bytes and their table."""
        out, table, shift = data[:start] + new + data[end:], last[: start + 1], len(new) - (end - start)
        for done in range(start + len(new) + self.longest, len(out), self.longest):
            self.extend(out[:done], table)
            if table[-self.longest :] == last[done - shift - self.longest + 1 : done - shift + 1]:
                return out, table + last[done - shift + 1 :]
        return out, self.extend(out, table)

    def read(self, last: list[int]) -> list[int]:
        out, i, size = [], len(last) - 1, self.size
        while i > 0:
            token = last[i]
            out.append(token)
            i -= size[token]
        out.reverse()
        return out

    def encode(self, data: bytes) -> list[int]:
        """A pretoken that is a token stands for itself, as in the public encoders."""
        if (own := self.ranks.get(data)) is not None:
            return [own]
        return self.read(self.extend(data, []))

    def encode_all(self, words) -> dict[bytes, list[int]]:
        """`encode` of each word: in order, so that a word goes on from the table of what it begins with."""
        out, last, states, before = {}, [-1], [0], b""
        own, onward, base, ending, size = self.ranks.get, self.next.get, self.base, self.ending, self.size
        for w in sorted(words):
            if (whole := own(w)) is not None:
                out[w] = [whole]
                continue
            same = 0
            for x, y in zip(w, before):
                if x != y:
                    break
                same += 1
            before = w
            del last[same + 1 :], states[same + 1 :]
            state, known = states[same], self.fits.get
            for b in w[same:]:  # as in `extend`, without a call for each word
                to = onward(state << 8 | b)
                state = self.step(state, b) if to is None else to
                states.append(state)
                for token, n in ending[state]:
                    left = last[-n]
                    good = known(left * base + token)
                    if good or good is None and self.new_pair(left, token):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends at byte {len(last)}")
            ids, i = [], len(w)
            while i:
                token = last[i]
                ids.append(token)
                i -= size[token]
            ids.reverse()
            out[w] = ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Memo:
    """Two generations of values by key. What the younger one lacks comes from the older one."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def missing(self, keys: set) -> set:
        """Those of `keys` that neither generation has; the younger one has the others from now on."""
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        out = keys.difference(self.young)
        for k in out.intersection(self.old):
            self.young[k] = self.old[k]
            out.discard(k)
        return out


class TextEncoder:
    """Encoder of whole texts: pretokens by `pattern`, each encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo_size: int = 150_000):
        import regex

        self.pairs, self.find = BytePairs(ranks), regex.compile(pattern).findall
        self.words, self.pieces = Memo(memo_size), Memo(memo_size)  # values: ids as text, and the bytes decoded from the ids

    def learn(self, keys: set) -> set:
        """Put pieces into the memo; returns those that it can't hold, since white space is at their ends.

        A key is a piece that has one space before it, or ALONE and any other piece.
        """
        new, uneven, spaced, found = self.pieces.missing(keys), set(), [], []
        for k in new:
            if k[:1] == ALONE:
                found.append((k, self.find(k[1:])))
            elif not k or k[0].isspace() or k[-1].isspace():
                uneven.add(k)
            elif len(k) > LONG:
                found.append((k, self.find(" " + k)))
            else:
                spaced.append(k)
        # no pretoken reaches over a change from non-space to space, and of a piece only the first begins with a space
        words = self.find(" " + " ".join(spaced)) if spaced else []
        made = self.words.missing(set(words).union(*(ws for _, ws in found)))
        put, decode = self.words.young, self.pairs.decode
        for w, ids in self.pairs.encode_all([w.encode() for w in made]).items():
            put[w.decode()] = " ".join(map(str, ids)), decode(ids)
        done, at = self.pieces.young, iter(spaced)
        for w in words:
            if w[0] == " ":
                k = next(at)
                done[k] = put[w]
            else:
                (a, x), (b, y) = done[k], put[w]
                done[k] = f"{a} {b}", x + y
        for k, ws in found:
            done[k] = " ".join([put[w][0] for w in ws]), b"".join([put[w][1] for w in ws])
        return uneven

    def encode_texts(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Of each text, its ids joined by spaces, and the bytes that these ids decode to."""
        parts = []
        for t in texts:
            own = t.split(" ")
            if own[0]:
                own[0] = ALONE + own[0]
            else:
                del own[0]  # nothing is before the first space, or the text is empty
            parts.append(own)
        uneven = self.learn(set().union(*parts))
        odd = [i for i, own in enumerate(parts) if own and own[0][-1:].isspace() or not uneven.isdisjoint(own)]
        if odd:
            for i in odd:
                parts[i] = [ALONE + p for p in PIECES.findall(texts[i])]
            self.learn(set().union(*parts))
        memo, out = self.pieces.young.__getitem__, []
        for own in parts:
            ids, raw = zip(*map(memo, own)) if own else ((), ())
            out.append((" ".join(ids), b"".join(raw)))
        return out

    def sleep(self) -> None:
        """At the end of a task: workers outlive tasks."""
        self.pairs.sleep()
        for memo in (self.words, self.pieces):
            memo.young, memo.old = {}, {}

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_texts([text])[0][0].split()]

    def decode(self, ids: list[int]) -> bytes:
        return self.pairs.decode(ids)


def slices(batches, rows: int = 500, size: int = 1_500_000):
    """(batch, its texts): smaller batches, so that the strings of one are few."""
    for batch in batches:
        at, texts, n = 0, [], 0
        for i, t in enumerate(batch.column("__text")):
            t = t.as_py() or ""
            if texts and (n + len(t) > size or len(texts) == rows):
                yield batch.slice(at, len(texts)), texts
                at, texts, n = i, [], 0
            texts.append(t)
            n += len(t)
        if texts:
            yield batch.slice(at, len(texts)), texts


_encoders: dict = {}


def encoder(path: str, pattern: str, memo_size: int) -> TextEncoder:
    key = (path, pattern, memo_size)
    if key not in _encoders:
        _encoders[key] = TextEncoder(load_ranks(path), pattern, memo_size)
        # the tables stay and hold no cycles: looking through them again and again costs a tenth of the time
        gc.freeze()
        gc.set_threshold(50_000, 20, 100)
    return _encoders[key]


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, memo_size: int = 150_000, ids: bool = True) -> DataFrame:
    """Encode and decode each text: key, `keep` columns, n_tokens, ids (decimal, space-joined; if wanted), ids_sha256, decoded_sha256.

    Map-only: no shuffle, and the vocabulary file is read once a worker. Pretokens are those of public_tokenizers.PATTERN: the
    memo rests on it, since none of its pretokens reaches from a non-space over a space.
    """
    import public_tokenizers

    path, pattern = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    keep = [key, *(keep or [])]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_tokens long, " + "ids string, " * ids + "ids_sha256 string, decoded_sha256 string"

    def run(batches):
        enc = encoder(path, pattern, memo_size)
        enc.pairs.wake()
        for batch, texts in slices(batches):
            pairs = enc.encode_texts(texts)
            n = [s.count(" ") + 1 if s else 0 for s, _ in pairs]
            coded, decoded = ([hashlib.sha256(x).hexdigest() for x in xs] for xs in ((s.encode() for s, _ in pairs), (raw for _, raw in pairs)))
            columns = [batch.column(c) for c in keep] + [pa.array(n, pa.int64())] + [pa.array([s for s, _ in pairs], pa.string())] * ids + [pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", *["ids"] * ids, "ids_sha256", "decoded_sha256"])
        enc.sleep()

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(released(run), schema)
