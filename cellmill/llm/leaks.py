"""Evaluation texts leaking into pages: q-gram lemma filtering in diagonal bands, banded alignment.

The items go to every task as tables of their character q-grams (``MOST_ITEMS`` a table). A page
is brought into reading order and folded to letters and digits. The q-grams it shares with an
item are counted in overlapping bands of diagonals; a band in which some passage of ``WORDS``
words keeps the q-grams that ``n - q + 1 - q * edits`` promises (the q-gram lemma) is aligned
with the item there, if bounds of its words' costs leave a leak possible, and the words that the
alignment confirms are counted. Filter and alignment have one budget: a letter in nearly every
word (``EDITS`` of the letters). Where the lemma promises less than ``FLOOR`` q-grams in
``TOUCHED`` words, that much is asked for, as less is met by chance.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellmill.llm.pages import reading_order
from cellmill.session import table

#: Consecutive words that make a leak; q; share of letters that may be misread; band of diagonals.
WORDS, Q, EDITS, BAND = 12, 5, 0.18, 32
#: Least q-grams of a candidate and least words that they lie in.
FLOOR, TOUCHED = 5, 3
#: The share where the lines of adverts have to be guessed as well (columns run together).
INNER_EDITS = 0.10
#: Items of one table and tables of one pass over the pages.
MOST_ITEMS, MOST_TABLES = 2000, 16
#: Letters often misread for one another, besides those the folding makes equal (fixed values).
CONFUSED = "ec hb hl tf tl tr oc oe ea an au ao il ij lj vy vr vn yj fs gq nu nr mn ui ul dl kl rv zs pn uo xz ar"
_FOLD = bytes.maketrans(b"01569ij", b"olsbgll")
_DROP = bytes(c for c in range(256) if not (48 <= c < 58 or 97 <= c < 123 or c == 10))
#: Multipliers of the q-gram hash.
_POWERS = np.array([pow(1_000_003, k, 1 << 64) for k in range(Q)], np.uint64)


def folded(text: str) -> bytes:
    """Letters and digits without case, accents and the commonest confusions; line ends stay."""
    t = text.lower().replace("ß", "ss").replace("œ", "oe").replace("æ", "ae")
    b = unicodedata.normalize("NFD", t).encode("ascii", "ignore").translate(None, _DROP)
    return b.replace(b"vv", b"w").replace(b"rn", b"m").replace(b"cl", b"d").replace(b"ii", b"u").translate(_FOLD)


def grams(b: np.ndarray) -> np.ndarray:
    """Hash of the q-gram that starts at each position."""
    n = len(b) - Q + 1
    h = np.zeros(max(n, 0), np.uint64)
    for k in range(Q):
        h += b[k : k + len(h)].astype(np.uint64) * _POWERS[k]
    return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(8)


@dataclass
class Items:
    """Folded items, their words, their q-grams sorted by hash.

    ``bounds``: q-grams that each passage of ``WORDS`` words must keep, a row an item (rows end in
    empty passages); ``word``: the word of each letter; ``count_words``: words of each item.
    ``need`` and ``tight``: least bound of an item, and with ``INNER_EDITS``. ``flat`` and
    ``offset``: letters of all items and where each begins; ``begin`` and ``most``: ``starts`` and
    ``allowed``, a row an item. ``code``: what each q-gram adds to the code of its place on a page.
    """

    ids: list[int]
    letters: list[np.ndarray]
    allowed: list[np.ndarray]
    starts: list[np.ndarray]
    need: np.ndarray
    tight: np.ndarray
    tight_bounds: list[np.ndarray]
    bounds: np.ndarray
    word: np.ndarray
    count_words: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    pos: np.ndarray
    bitmap: np.ndarray
    flat: np.ndarray
    offset: np.ndarray
    begin: np.ndarray
    most: np.ndarray
    code: np.ndarray

    @property
    def bits(self) -> int:
        """Bits of a position in an item."""
        return self.word.shape[1].bit_length()

    @property
    def shift(self) -> int:
        """Added to diagonals, which are then not negative; whole half bands."""
        return (self.word.shape[1] // (BAND // 2) + 2) * (BAND // 2)

    def codes(self, page, item, ipos, diag):
        """Numbers that sort by page, item, diagonal and position in the item, the last in ``bits`` bits, the diagonal in 24."""
        return (((page * len(self.ids) + item) << 24) + diag + self.shift << self.bits) + ipos


def bound(letters: int, edits: float = EDITS) -> int:
    """Q-grams that a region of so many letters keeps at least within its edit budget."""
    return max(FLOOR, int(np.floor(letters - Q + 1 - Q * edits * letters)))


def prepare(rows) -> Items:
    ids, letters, allowed, starts, sizes = [], [], [], [], []
    for item_id, text in rows:
        words = [w for w in (folded(w) for w in (text or "").split()) if w]
        if len(words) < WORDS:
            continue
        raw = [w for w in (text or "").split() if folded(w)]
        ends = np.cumsum([len(w) for w in words])
        sizes.append(ends[WORDS - 1 :] - np.r_[0, ends[:-WORDS]])  # letters of each passage of so many words
        starts.append(np.r_[0, ends])
        ids.append(item_id)
        letters.append(np.frombuffer(b"".join(words), np.uint8))
        # cost of a word that still counts: about a fifth of its letters wrong, one at least; short figures must be right
        allowed.append(np.array([(0 if len(w) < 3 else 2) if any(c.isdigit() for c in r) else max(2, 1 + (len(w) + 3) // 4) for w, r in zip(words, raw, strict=True)]))
    n, most, longest = len(ids), max(map(len, sizes), default=0), max((len(x) for x in letters), default=0)
    bounds = np.full((n, most), 1 << 30)
    word = np.zeros((n, longest + Q), int)
    for k, (st, each) in enumerate(zip(starts, sizes, strict=True)):
        bounds[k, : len(each)] = [bound(int(x)) for x in each]
        word[k] = np.minimum(np.searchsorted(st, np.arange(longest + Q), "right") - 1, len(st) - 2)
    tight = [np.array([bound(int(x), INNER_EDITS) for x in each]) for each in sizes]
    h = [grams(x) for x in letters]
    allh = np.concatenate(h) if h else np.empty(0, np.uint64)
    item = np.concatenate([np.full(len(x), i) for i, x in enumerate(h)]) if h else np.empty(0, int)
    pos = np.concatenate([np.arange(len(x)) for x in h]) if h else np.empty(0, int)
    order = np.argsort(allh, kind="stable")
    hashes, first, count = np.unique(allh[order], return_index=True, return_counts=True)
    bitmap = np.zeros(1 << 20, bool)
    bitmap[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
    flat = np.concatenate(letters) if n else np.zeros(1, np.uint8)
    offset = np.cumsum([0, *map(len, letters)])[:n]
    widest = max(map(len, starts), default=1)
    begin, costs = np.zeros((n, widest), int), np.zeros((n, widest), int)
    for k, (st, al) in enumerate(zip(starts, allowed, strict=True)):
        begin[k] = np.r_[st, np.full(widest - len(st), st[-1])]
        costs[k, : len(al)] = al
    out = Items(ids, letters, allowed, starts, bounds.min(1) if n else np.empty(0, int), np.array([x.min() for x in tight], int), tight, bounds, word, np.array([len(st) - 1 for st in starts], int), hashes, first, count, item[order], pos[order], bitmap, flat, offset, begin, costs, order)
    out.code = out.codes(0, out.item, out.pos, -out.pos)
    return out


def _costs() -> np.ndarray:
    c = np.full((128, 128), 2, np.int16)
    for pair in CONFUSED.split():
        a, b = ord(pair[0]), ord(pair[1])
        c[a, b] = c[b, a] = 1
    np.fill_diagonal(c, 0)
    return c


COSTS = _costs()
_HALF = 24  # half the width of the alignment's band


#: Trigrams tell candidates from chance: half the width they are sought in, and their lemma's share of edits.
_NEAR, TRIGRAM_EDITS = 16, 0.23


@dataclass
class Pairs:
    """Candidates: the page text of each, the item, first and end word, and the diagonal; letters of all texts and where each begins."""

    letters: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    text: np.ndarray
    item: np.ndarray
    first: np.ndarray
    end: np.ndarray
    diag: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], text, item, first, end, diag) -> Pairs:
        sizes = np.array([len(t) for t in texts], int)
        return cls(np.frombuffer(b"".join(texts) + b"\2", np.uint8), np.cumsum(sizes) - sizes, sizes, *(np.asarray(v, int) for v in (text, item, first, end, diag)))

    def __len__(self) -> int:
        return len(self.item)

    def take(self, some: np.ndarray) -> Pairs:
        return Pairs(self.letters, self.starts, self.sizes, *(v[some] for v in (self.text, self.item, self.first, self.end, self.diag)))

    def batches(self, items: Items, size: int):
        """Numbers of the pairs, those of about as many letters together, and the pairs."""
        order = np.argsort(items.begin[self.item, self.end] - items.begin[self.item, self.first], kind="stable")
        for s in range(0, len(order), size):
            yield order[s : s + size], self.take(order[s : s + size])

    def windows(self, items: Items, half: int):
        """Letters of the items' words, letters of the pages around them, and how many the words have.

        ``pg[r, t]`` is ``half`` letters before item letter t on the diagonal; 1 and 2 fill up.
        """
        at = items.begin[self.item, self.first]
        lens = items.begin[self.item, self.end] - at
        t = np.arange(int(lens.max()))
        it = items.flat.take((items.offset[self.item] + at)[:, None] + t, mode="clip")
        it[t >= lens[:, None]] = 1
        place = (at + self.diag - half)[:, None] + np.arange(len(t) + 2 * half + 1)
        pg = self.letters.take(self.starts[self.text][:, None] + place, mode="clip")
        pg[(place < 0) | (place >= self.sizes[self.text][:, None])] = 2
        return it, pg, lens


def plausible(pairs: Pairs, items: Items) -> np.ndarray:
    """Which pairs keep enough trigrams near their diagonal in some passage.

    The lemma again with q = 3, whose bound stays above chance for more edits than the filter's
    own: ``n - 2 - 3 * TRIGRAM_EDITS * n`` of the trigrams of a passage of n letters, each on any
    of the diagonals near the candidate's. A comparison of letters, far cheaper than alignment.
    """
    out = np.zeros(len(pairs), bool)
    for some, part in pairs.batches(items, 512):
        it, pg, _ = part.windows(items, _NEAR)
        longest = it.shape[1]
        have = np.zeros((len(some), longest - 2), bool)
        for t in range(2 * _NEAR + 1):
            same = it == pg[:, t : t + longest]
            have |= same[:, :-2] & same[:, 1:-1] & same[:, 2:]
        total = np.zeros((len(some), longest - 1), np.int32)
        np.cumsum(have, axis=1, out=total[:, 1:])
        w = part.first[:, None] + np.arange(int((part.end - part.first).max()) - WORDS + 1)
        inside = w + WORDS <= part.end[:, None]
        w = np.where(inside, w, part.first[:, None])
        item, at = part.item[:, None], items.begin[part.item, part.first][:, None]
        a, b = items.begin[item, w] - at, items.begin[item, w + WORDS] - at
        n, r = b - a, np.arange(len(some))[:, None]
        out[some] = (inside & (total[r, np.maximum(b - 2, 0)] - total[r, a] >= n - 2 - 3 * TRIGRAM_EDITS * n)).any(1)
    return out


def possible(pairs: Pairs, items: Items) -> np.ndarray:
    """Which pairs may have ``WORDS`` words confirmed by ``align``: a condition that these always meet.

    A word of allowed cost has e = cost / 2 letters put in or left out at most, so it lies on e + 1
    neighbouring diagonals; each letter costs what it costs on the best of them at least. The next
    word begins where the last one ends or a letter later, or no run goes on from one to the other.
    """
    n, width = len(pairs), 2 * _HALF + 1
    if not n:
        return np.zeros(0, bool)
    order = np.argsort(pairs.text, kind="stable")
    pairs = pairs.take(order)
    letters = items.begin[pairs.item, pairs.end] - items.begin[pairs.item, pairs.first]
    new = np.r_[True, pairs.text[1:] != pairs.text[:-1]]
    cost = np.cumsum(letters + np.where(new, pairs.sizes[pairs.text], 0)) >> 16
    bounds = [0, *(np.flatnonzero(cost[1:] != cost[:-1]) + 1).tolist(), n]
    spread = min(int(items.most.max()) // 2, width - 1)
    good, words = [], pairs.end - pairs.first
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        texts, of = np.unique(pairs.text[lo:hi], return_inverse=True)
        fill = np.full(width + spread, 2, np.uint8)
        page = [fill]
        for t in texts:
            page += [pairs.letters[pairs.starts[t] : pairs.starts[t] + pairs.sizes[t]], fill]
        page = np.concatenate(page)
        start = np.cumsum(np.r_[0, pairs.sizes[texts[:-1]] + len(fill)])[of] + len(fill)
        known, boards = np.zeros(128, int), []
        for k, c in enumerate(np.unique(items.flat)):
            known[c] = k * len(page)
            boards.append(COSTS[c].astype(np.uint8).take(page))
        rows = np.lib.stride_tricks.sliding_window_view(np.concatenate(boards), width + spread)
        # words of the pairs, then letters of the words
        of = np.repeat(np.arange(lo, hi), words[lo:hi])
        item, w = pairs.item[of], pairs.first[of] + np.arange(len(of)) - (np.cumsum(words[lo:hi]) - words[lo:hi])[of - lo]
        begin, allowed = items.begin[item, w], items.most[item, w]
        size = items.begin[item, w + 1] - begin
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(of)), size)
        at = (begin - first)[word] + np.arange(len(word))
        pair = of[word]
        place = np.clip(at + pairs.diag[pair] - _HALF, -len(fill), pairs.sizes[pairs.text[pair]])
        each = rows[known[items.flat[items.offset[item[word]] + at]] + start[pair - lo] + place]
        best = each[:, :width].copy()
        for t in range(1, spread + 1):
            some = np.flatnonzero((allowed >= 2 * t)[word])
            if 2 * len(some) < len(best):
                best[some] = np.minimum(best[some], each[some, t : t + width])
                continue
            others = np.flatnonzero((allowed < 2 * t)[word])
            before = best[others]
            np.minimum(best, each[:, t : t + width], out=best)
            best[others] = before
        # the first letters of all words, the second ones, and so on
        by = np.argsort(-size, kind="stable")
        first, sizes = first[by], size[by]
        paid = np.zeros((len(of), width), np.uint8 if sizes[0] < 128 else np.int32)
        for t, live in enumerate(len(of) - np.cumsum(np.bincount(sizes))[:-1]):
            paid[:live] += best[first[:live] + t]
        fits = np.empty(paid.shape, bool)
        fits[by] = paid <= allowed[by, None]
        good.append(fits)
    good = np.concatenate(good)
    row, by = np.cumsum(words) - words, np.argsort(-words, kind="stable")
    run, longest = np.zeros((n, width + 2 * spread + 1), np.int16), np.zeros(n, np.int16)
    for t in range(int(words.max())):
        live = int((words > t).sum())
        now = run[:live, :width].copy()
        for k in range(1, 2 * spread + 2):
            np.maximum(now, run[:live, k : k + width], out=now)
        now = (now + 1) * good[row[by[:live]] + t]
        run[:live, spread + 1 : spread + 1 + width] = now
        np.maximum(longest[:live], now.max(1), out=longest[:live])
    out = np.zeros(n, bool)
    out[order[by]] = longest >= WORDS
    return out


def align(pairs: Pairs, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Longest run of confirmed words of each pair, and the word it begins with.

    Unit edits cost 2, confusable letters 1. The item's words are aligned with the page inside
    the band, page ends free; a batch of pairs runs in step.
    """
    out, begins = np.zeros(len(pairs), int), np.zeros(len(pairs), int)
    for some, part in pairs.batches(items, 256):
        count, width = len(some), 2 * _HALF + 1
        it, pg, lens = part.windows(items, _HALF + 1)
        n_max = it.shape[1]
        step = 2 * np.arange(width, dtype=np.int16)
        flat, base, letters = COSTS.ravel(), it.astype(np.int32) * 128, pg.astype(np.int32)
        costs = np.empty((n_max + 1, count, width), np.int16)
        row = np.zeros((count, width), np.int16)
        costs[0] = row
        for i in range(1, n_max + 1):
            sub = row + flat.take(base[:, i - 1, None] + letters[:, i : i + width])
            sub[:, :-1] = np.minimum(sub[:, :-1], row[:, 1:] + 2)
            row = np.minimum.accumulate(sub - step, axis=1) + step
            costs[i] = row
        who = np.arange(count)
        i, k = lens.copy(), costs[lens, who].argmin(1)
        spent = np.zeros((count, n_max + 1), np.int16)  # on each item letter
        gap = np.zeros((count, n_max + 1), np.int16)  # page letters put in before each item letter
        live = i > 0
        while live.any():
            now = costs[i, who, k]
            up = np.maximum(i - 1, 0)
            c = COSTS[it[who, up], pg[who, i + k]]
            is_sub = live & (costs[up, who, k] + c == now)
            k1 = np.minimum(k + 1, width - 1)
            is_del = live & ~is_sub & (k < width - 1) & (costs[up, who, k1] + 2 == now)
            is_ins = live & ~is_sub & ~is_del
            spent[who[is_sub], up[is_sub]] = c[is_sub]
            spent[who[is_del], up[is_del]] = 2
            gap[who[is_ins], i[is_ins]] += 1
            i = np.where(is_sub | is_del, up, i)
            k = np.where(is_del, k1, np.where(is_ins, np.maximum(k - 1, 0), k))
            live = live & (i > 0)
        for r, (p, item, first, end) in enumerate(zip(some.tolist(), part.item.tolist(), part.first.tolist(), part.end.tolist(), strict=True)):
            begin = items.starts[item][first:end] - items.starts[item][first]
            paid = np.add.reduceat(spent[r, : lens[r]], begin)
            inside = gap[r, : lens[r]].copy()
            before = inside[begin] > 1  # other words stand before this one
            inside[begin] = 0
            paid = paid + 2 * np.add.reduceat(inside, begin)
            run = 0
            for w, (good, cut) in enumerate(zip(paid <= items.allowed[item][first:end], before, strict=True)):
                run = (0 if cut else run) + 1 if good else 0
                if run > out[p]:
                    out[p], begins[p] = run, first + w + 1 - run
    return out, begins


def kept(owner: np.ndarray, item: np.ndarray, ipos: np.ndarray, items: Items):
    """For candidates (``item`` each) and their q-gram positions (``owner`` of each): first and end word of
    the part of the item whose passages keep enough q-grams in enough words, and whether there is one."""
    n, width, word = len(item), items.word.shape[1], items.word.ravel()
    most = items.begin.shape[1]  # one more than the words
    at, place = item[owner] * width + ipos, owner * most
    words = [word[at + k] for k in range(Q)]
    have = np.zeros((n, most), np.int32)
    have[:, 1:] = np.bincount(place + words[0], minlength=n * most).reshape(n, most)[:, :-1]
    np.cumsum(have, axis=1, out=have)
    have[:, WORDS:] -= have[:, :-WORDS].copy()
    # not those that reach into the word after the passage
    over = np.concatenate([(place + v)[v != u] for u, v in zip(words, words[1:], strict=False)])
    have -= np.bincount(over, minlength=n * most).reshape(n, most)
    touched = np.zeros((n, most), np.int16)
    for v in (words[0], words[-1]):
        touched[owner, v + 1] = 1
    np.cumsum(touched, axis=1, out=touched)
    ok = (have[:, WORDS:] >= items.bounds[item]) & (touched[:, WORDS:] - touched[:, :-WORDS] >= TOUCHED)
    last = ok.shape[1] - 1 - ok[:, ::-1].argmax(1)
    return np.maximum(ok.argmax(1) - 1, 0), np.minimum(last + WORDS + 1, items.count_words[item]), ok.any(1)


def banded(codes: np.ndarray, items: Items, need: np.ndarray):
    """Candidates (arrays of page, item, first word, end word, diagonal) from sorted codes of shared q-grams.

    Bands of diagonals overlap by half; neighbouring bands of an item make one candidate, on
    the diagonal of the one with more q-grams. ``need``: least q-grams of each item's bands.
    """
    many, bits = len(items.ids), items.bits
    none = tuple(np.empty(0, int) for _ in range(5))
    key = codes >> bits + (BAND // 2).bit_length() - 1  # half bands
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, int)
    count, key = np.diff(np.r_[cuts, len(key)]), key[cuts]
    # a band begins with each half band, and one half earlier where that is empty
    next_ = np.r_[key[1:] == key[:-1] + 1, False][: len(key)]
    full = count + np.where(next_, np.r_[count[1:], 0][: len(key)], 0)
    alone = np.where(np.r_[False, next_[:-1]][: len(key)], 0, count)
    least = need[(key >> 20) % many]
    some = np.flatnonzero(np.stack([alone >= least, full >= least], 1).ravel())
    if not len(some):
        return none
    half, late = some >> 1, some & 1
    key, count, begin = key[half] - 1 + late, np.where(late, full[half], alone[half]), cuts[half]
    of = (codes[begin] >> bits + 24) % many
    owner = np.repeat(np.arange(len(some)), count)
    rows = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(len(owner))
    # most bands have too few different q-grams within so many words
    ipos = codes[rows] & (1 << bits) - 1
    each = np.sort((owner << bits) + ipos)
    each = each[np.r_[True, each[1:] != each[:-1]]]
    who, word = each >> bits, items.word[of[each >> bits], each & (1 << bits) - 1]
    last = np.arange(len(each)) + items.need[of[who]] - 1
    inside = last < len(each)
    last = np.where(inside, last, 0)
    keep = np.zeros(len(some), bool)
    keep[who[inside & (who[last] == who) & (word[last] - word < WORDS)]] = True
    ends = np.flatnonzero(np.r_[who[1:] != who[:-1], True])
    keep &= word[ends] - word[np.r_[0, ends[:-1] + 1]] > 0  # a q-gram may reach into one word more
    some = np.flatnonzero(keep)
    if not len(some):
        return none
    number = np.cumsum(keep) - 1
    inside = keep[who]
    first, end, ok = kept(number[who[inside]], of[some], each[inside] & (1 << bits) - 1, items)
    some, first, end = some[ok], first[ok], end[ok]
    if not len(some):
        return none
    diag = np.bincount(owner, (codes[rows] >> bits & (1 << 24) - 1) - items.shift + 0.0, len(keep))[some] / count[some]
    key, count, of = key[some], count[some], of[some]
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1] + 1])
    chain = np.cumsum(np.r_[True, key[1:] != key[:-1] + 1]) - 1
    best = np.flatnonzero(count == np.maximum.reduceat(count, cuts)[chain])
    best = best[np.unique(chain[best], return_index=True)[1]]
    return (codes[begin[some[cuts]]] >> bits + 24) // many, of[cuts], np.minimum.reduceat(first, cuts), np.maximum.reduceat(end, cuts), diag[best].astype(int)


@cache
def _runs(n: int):
    return np.triu_indices(n, 1)


def left_out(line: np.ndarray, ipos: np.ndarray, diag: np.ndarray, edges: np.ndarray, need: int):
    """Sets of lines that other text fills, one for each chain of an item's hits on a page.

    The hits of a line on one diagonal are a link. A link follows another on a later line, or on
    the same one, further on in the item, if it continues the diagonal or does so once whole
    lines between them, however many, are left out; where no run of lines has just the letters
    that the diagonal has moved by, all lines between are. The heaviest chain comes first, then
    the heaviest of the links that remain, while it has ``need`` hits. ``edges``: letters before
    each line.
    """
    order = np.lexsort((ipos, diag, line))
    line, ipos, diag = line[order], ipos[order], diag[order]
    cuts = np.flatnonzero(np.r_[True, (line[1:] != line[:-1]) | (diag[1:] - diag[:-1] > _HALF // 2)])
    ends = np.r_[cuts[1:], len(line)]
    n = ends - cuts
    ln = line[cuts]
    dg = (diag[cuts + ends - 1 >> 1] + diag[cuts + ends >> 1]) / 2  # medians
    lo, hi = np.minimum.reduceat(ipos, cuts), np.maximum.reduceat(ipos, cuts)
    order = np.lexsort((lo, ln))
    order = order[n[order] > 1]  # a single hit is mostly chance, and what continues a diagonal needs none
    n, ln, dg, lo, hi = (v[order] for v in (n, ln, dg, lo, hi))
    between: dict[tuple[int, int], tuple] = {}

    def skipped(s: int, t: int):
        """Lines left out from link s to link t, none to continue; None if t cannot follow s."""
        shift, slack = dg[t] - dg[s], _HALF // 2 + INNER_EDITS * max(0, lo[t] - hi[s])
        if abs(shift) <= slack:
            return ()
        if ln[t] - ln[s] < 2 or shift < 0:
            return None
        if (key := (ln[s], ln[t])) not in between:
            e = edges[ln[s] + 1 : ln[t] + 1]
            a, b = _runs(len(e))
            between[key] = (e[b] - e[a], ln[s] + 1 + a, ln[s] + 1 + b)
        size, a, b = between[key]
        best = int(np.abs(size - shift).argmin())
        if abs(size[best] - shift) <= slack:
            return tuple(range(a[best], b[best]))
        # lines run together with others or in several places: at most all of them, and not more letters than they have
        return tuple(range(ln[s] + 1, ln[t])) if shift <= size.max() + slack else None

    live = np.ones(len(n), bool)
    while live.any():
        links = np.flatnonzero(live)
        weight, before = n.astype(float), np.full(len(n), -1)
        for t in links:
            prior = links[(ln[links] <= ln[t]) & (hi[links] <= lo[t] + Q) & (lo[links] < lo[t]) & (links < t)]
            # the heaviest first: the first that may be followed is the best
            for s in prior[np.argsort(-weight[prior], kind="stable")]:
                if skipped(s, t) is not None:
                    weight[t] += weight[s]
                    before[t] = s
                    break
        t = int(links[weight[links].argmax()])
        if weight[t] < need:
            return
        out: set[int] = set()
        while t >= 0:
            live[t] = False
            if before[t] >= 0:
                out |= set(skipped(before[t], t))
            t = before[t]
        yield frozenset(out)


def _enough(item: int, ipos: np.ndarray, items: Items) -> bool:
    """Does a passage of the item keep enough of the q-gram positions, by the tighter budget?"""
    st = items.starts[item]
    have = np.zeros(st[-1] + 2, np.int32)
    have[ipos + 1] = 1
    have = np.cumsum(have)
    return bool((have[np.maximum(st[WORDS:] - Q + 1, 0)] - have[st[:-WORDS]] >= items.tight_bounds[item]).any())


def _confirmed(pairs: Pairs, items: Items) -> np.ndarray:
    """Which candidates' alignment confirms ``WORDS`` words."""
    found = np.zeros(len(pairs), bool)
    likely = np.flatnonzero(plausible(pairs, items))
    likely = likely[possible(pairs.take(likely), items)]
    if not len(likely):
        return found
    some = pairs.take(likely)
    runs, begins = align(some, items)
    found[likely[runs >= WORDS]] = True
    # just short of it: words beyond the passage may have drawn its ends away, so each passage around the run is tried alone
    close = np.flatnonzero((runs >= WORDS - 4) & (runs < WORDS))
    alone = [(k, s) for k in close for s in range(max(some.first[k], begins[k] + runs[k] - WORDS), min(begins[k], some.end[k] - WORDS) + 1)]
    if alone:
        of, at = np.array(alone).T
        parts = some.take(of)
        parts.first, parts.end = at, at + WORDS
        found[likely[of[align(parts, items)[0] >= WORDS]]] = True
    return found


def scan(pages: list[tuple[bytes, bool]], items: Items) -> list[tuple[int, int]]:
    """(page number, item number) of every leak in a batch of folded pages (line ends kept, inner flag)."""
    if not items.ids:
        return []
    if len(pages) > 1 and (len(pages) * len(items.ids)).bit_length() + 24 + items.bits > 63:  # of a code
        middle = len(pages) // 2
        return scan(pages[:middle], items) + [(p + middle, i) for p, i in scan(pages[middle:], items)]
    flat = [p.replace(b"\n", b"") for p, _ in pages]
    sizes = np.array([len(f) + Q for f in flat])
    starts = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"".join(f + b"\0" * Q for f in flat), np.uint8)
    h = grams(joined)
    hit = items.bitmap[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
    at = np.flatnonzero(hit)
    k = np.minimum(np.searchsorted(items.hashes, h[at]), len(items.hashes) - 1)
    true = items.hashes[k] == h[at]
    at, k = at[true], k[true]
    if not len(at):
        return []
    page_of = np.searchsorted(starts, at, "right") - 1
    rep = items.count[k]
    idx = np.repeat(items.first[k] - np.cumsum(rep) + rep, rep) + np.arange(rep.sum())
    many, bits = len(items.ids), items.bits
    codes = np.sort(np.repeat((page_of * many << 24 + bits) + (at - starts[page_of] << bits), rep) + items.code[idx])
    pairs = Pairs.of(flat, *banded(codes, items, items.need))
    yes = _confirmed(pairs, items)
    found = set(zip(pairs.text[yes].tolist(), pairs.item[yes].tolist(), strict=True))
    # inner adverts have no box: they are the lines left out between neighbours of a chain of hits
    both = codes >> bits + 24
    codes = codes[np.array([flag for _, flag in pages])[both // many]]
    both = codes >> bits + 24
    cuts = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.empty(0, int)
    ends = np.r_[cuts[1:], len(both)]
    # too few q-grams even without regard to their places do not matter
    some = np.flatnonzero(ends - cuts >= items.tight[both[cuts] % many])
    names, texts, parts = [], [], []
    for a, e in zip(cuts[some].tolist(), ends[some].tolist(), strict=True):
        p, i = divmod(int(both[a]), many)
        ip = codes[a:e] & (1 << bits) - 1
        if (p, i) in found or not _enough(i, ip, items):
            continue
        at_ = (codes[a:e] >> bits & (1 << 24) - 1) - items.shift + ip
        cells = pages[p][0].split(b"\n")
        edges = np.cumsum([0] + [len(c) for c in cells])
        on = np.searchsorted(edges[1:], at_, "right")
        tried = set()
        for out in left_out(on, ip, at_ - ip, edges, int(items.tight[i])):
            if not out or out in tried:
                continue
            tried.add(out)
            cum = np.cumsum([0] + [len(c) if n in out else 0 for n, c in enumerate(cells)])
            left = ~np.isin(on, list(out))
            moved = at_[left] - cum[on[left]]
            got = banded(np.sort(items.codes(0, i, ip[left], moved - ip[left])), items, items.tight)
            if len(got[0]):
                parts.append((got[0] + len(texts), *got[1:]))
                names.append((p, i))
                texts.append(b"".join(c for n, c in enumerate(cells) if n not in out))
    if parts:
        pairs = Pairs.of(texts, *(np.concatenate(v) for v in zip(*parts, strict=True)))
        found |= {names[t] for t in pairs.text[_confirmed(pairs, items)]}
    return sorted(found)


def leaks(docs: DataFrame, items: DataFrame, seed: int = 0) -> DataFrame:
    """item_id, doc_id of every page that carries ``WORDS`` consecutive words of an item.

    ``docs``: doc_id, text, line_boxes; ``items``: item_id, text. Null texts carry nothing, items
    of fewer words cannot leak, equal items are each reported, empty tables give no rows. Texts
    are read whole, once for every ``MOST_ITEMS`` x ``MOST_TABLES`` items.
    """
    known = items.where("item_id is not null and text is not null").select("item_id", "text").dropDuplicates()
    most = MOST_ITEMS * MOST_TABLES
    rows = known.orderBy("item_id").limit(most + 1).collect()
    if len(rows) > most:
        n = -(-known.count() // most) * 2
        parts = [leaks(docs, known.where(F.pmod(F.xxhash64("item_id", "text", F.lit(seed)), F.lit(n)) == i), seed + 1) for i in range(n)]
        return reduce(DataFrame.unionByName, parts).distinct()
    spark = docs.sparkSession
    tables = [prepare([(r["item_id"], r["text"]) for r in rows[k : k + MOST_ITEMS]]) for k in range(0, len(rows), MOST_ITEMS)]
    shared = spark.sparkContext.broadcast(tables)  # MOST_TABLES tables of MOST_ITEMS items at most
    pages = docs.where("doc_id is not null and text is not null and length(text) > 0").select("doc_id", "text", F.col("line_boxes.x0").alias("x0"), F.col("line_boxes.y0").alias("y0"), F.col("line_boxes.x1").alias("x1"))

    def find(batches):
        for batch in batches:
            for s in range(0, batch.num_rows, 500):
                part = batch.slice(s, 500)
                doc_ids = part.column("doc_id").to_pylist()
                cols = [part.column(c).to_pylist() for c in ("text", "x0", "y0", "x1")]
                ready = []
                for text, x0, y0, x1 in zip(*cols, strict=True):
                    pieces, inner = reading_order(text, x0, y0, x1)
                    ready.append((folded("\n".join(pieces)), inner))
                found = [(t.ids[i], doc_ids[p]) for t in shared.value for p, i in scan(ready, t)]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([d for _, d in found], pa.int64())], names=["item_id", "doc_id"])

    return pages.mapInArrow(find, "item_id bigint, doc_id bigint").distinct()


def p6_found(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_items(spark, sf_dir):
    """Leaked items with the number of pages that carry them."""
    return p6_found(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("pages"))
