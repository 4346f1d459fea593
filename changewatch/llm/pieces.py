"""SentencePiece encoding and decoding with seeded merge-dropout.

Encoding follows the merge type of the vocabulary: from single characters on, an agenda
of neighbouring pairs that form a piece is worked off from the best score (of equal ones
the leftmost). With ``dropout`` > 0 each candidate taken from the agenda is skipped with that
probability; it can only come back as part of a new pair. A text is cut into units, which no
piece of the vocabulary crosses: white space signs and what follows up to the next one.

Each candidate of each occurrence of a unit has a draw of its own, a keyed hash of (seed, turn,
document's key, number of the unit in the document, number of the candidate in the agenda of that
occurrence). So equal (seed, turn, key, text) always give equal ids, on whatever executor and
however often, while a word is cut anew wherever it occurs; another ``turn`` cuts all of it anew.
Without dropout the ids are those of the vocabulary's own encoder.

What is kept between occurrences is only what follows from their draws: the ids of a unit if nothing
is skipped, and if only one candidate is. States not met before come from the agendas of many units
worked off together, as columns of one numpy array. An occurrence that skips more, and one of a unit that is
new and alone in its stretch of texts, has an agenda of its own in such an array, of which nothing is kept.
A long unit (over ``LONG`` characters) has a heap of its own. The results are the same.

Decoding is lossless with and without dropout: characters that are no piece become byte pieces,
and so does the white space sign itself where it occurs in a text.

The vocabulary is a file of the SentencePiece library, given by a path that executors can read;
pieces and scores are read from it, the encoder is this one.

Defined cases: a null text has null ids; an empty one none. Ids of another vocabulary or bytes
that are no UTF-8 decode with replacement characters. A null key counts as an empty one. Other
columns are passed through; columns named like the output are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import query, table, with_fields
from .vec import MULTIPLIER, freed_after, splitmix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
DROPOUT = 0.1
SEED = 2024
CACHE = 250_000
LONG = 48
NEVER = 1 << 30
BATCH = 8_000
PART = 1 << 20

ESCAPED = ""  # stands among the units for a white space sign of the text itself


def hashes(keys: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The draws of these numbers in the streams of these keys (uint64), 24 bits each."""
    return splitmix(keys + numbers.astype(np.uint64) * np.uint64(MULTIPLIER)) >> np.uint64(40)


class Column:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: type):
        self.size, self.room = 0, np.zeros(1024, dtype)

    @property
    def data(self) -> np.ndarray:
        return self.room[: self.size]

    def add(self, values: np.ndarray | list[int]) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            room = np.zeros(max(end, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.data
            self.room = room
        self.room[self.size : end] = values
        self.size = end


class States:
    """By state: its unit, the candidate that is skipped (-1: none), the ids, number of the first candidate not drawn
    for yet, how many there are, and the state that a skip of each of them leads to (-1: not known yet)."""

    def __init__(self) -> None:
        self.of_unit: dict[str, int] = {}
        self.units: list[str] = []
        self.ids, self.begin, self.n_ids = Column(np.int32), Column(np.int64), Column(np.int32)
        self.first, self.draws = Column(np.int32), Column(np.int32)
        self.next, self.next_begin = Column(np.int32), Column(np.int64)

    def add(self, units: list[str], skipped: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, draws: np.ndarray) -> int:
        """The first of these states; ``draws``: how many candidates are drawn for in all, with those up to the skipped one."""
        at = len(self.units)
        first = skipped + 1
        own = draws - first
        self.units += units
        self.begin.add(self.ids.size + np.cumsum(n_ids) - n_ids)
        self.n_ids.add(n_ids)
        self.ids.add(ids)
        self.first.add(first)
        self.draws.add(own)
        # from a state with a skip no further one is kept
        ways = np.where(skipped < 0, own, 0)
        self.next_begin.add(self.next.size + np.cumsum(ways) - ways)
        self.next.add(np.full(int(ways.sum()), -1))
        return at


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class Pieces:
    """The vocabulary, with states of units kept up to a bounded number."""

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in every]
        byte = {i: int(names[i][3:5], 16) for i in every if model.is_byte(i)}
        self.byte_id = {b: i for i, b in byte.items()}
        self.bytes_of = [bytes([byte[i]]) if i in byte else names[i].replace(SPACE, " ").encode() for i in every]
        plain = [i for i in every if not (i in byte or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {names[i]: i for i in plain}
        # place in the order of scores: the best is 0
        places = {score: k for k, score in enumerate(sorted({model.get_score(i) for i in plain}, reverse=True))}
        self.rank = {names[i]: places[model.get_score(i)] for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece of this vocabulary goes on after white space; units cannot be cut there")
        # neighbours (left, right) that form a piece, and the piece at each place
        self.size = len(names)
        pairs = {}
        for piece, place in self.rank.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 21 | right] = place, self.ids[piece]
        self.pair_places = np.array([*(place for place, _ in pairs.values()), NEVER], np.int32)  # the last, -1: no pair
        self.pair_ids = np.array([i for _, i in pairs.values()], np.int32)
        self._hashed(np.fromiter(pairs, np.int64, len(pairs)))
        self.at_place = np.zeros(len(places), np.int32)
        self.at_place[[self.rank[p] for p in self.ids]] = list(self.ids.values())
        # pieces of equal score share a place: there the pair tells which one it is
        shared = np.bincount([self.rank[p] for p in self.ids], minlength=len(places)) > 1
        self.at_place[shared] = -1
        # a character that is no piece stands for itself, beyond the ids
        self.of_char = np.arange(0x110000, dtype=np.int32) + self.size
        single = [p for p in self.ids if len(p) == 1]
        self.of_char[[ord(p) for p in single]] = [self.ids[p] for p in single]
        self.limit, self.seed = int(dropout * (1 << 24)), seed
        self.escaped = self._in_bytes(SPACE)
        self.states = States()

    def _hashed(self, keys: np.ndarray) -> None:
        """Numbers of pairs by slots, of which one in eight is taken at most; a pair whose slot is taken has the next free one."""
        bits = max(8 * len(keys), 2).bit_length()
        self.slot_shift = np.uint64(64 - bits)
        self.slots, self.slot_keys = np.full(1 << bits, -1, np.int32), np.full(1 << bits, -1, np.int64)
        at = (keys.astype(np.uint64) * np.uint64(MULTIPLIER) >> self.slot_shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = free  # one of those that meet in a slot
            left = left[self.slots[at[left]] != left]
            at[left] = at[left] + 1 & len(self.slots) - 1
        self.slot_keys[at] = keys

    def _in_bytes(self, text: str) -> list[int]:
        return [self.byte_id[b] for b in text.encode("utf-8", "replace")]

    def _places(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and place of the pair of each of these neighbours; place NEVER where they form no piece or there is none (-1)."""
        key = left.astype(np.int64) << 21 | right
        at = (key.astype(np.uint64) * np.uint64(MULTIPLIER) >> self.slot_shift).astype(np.int64)
        found = self.slots[at]
        # a slot taken by another pair: the next one
        open_ = np.flatnonzero((self.slot_keys[at] != key) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & len(self.slots) - 1
            found[open_] = self.slots[at[open_]]
            open_ = open_[(self.slot_keys[at[open_]] != key[open_]) & (found[open_] >= 0)]
        return found, self.pair_places[found]

    def _merged(self, units: list[str], keys: np.ndarray | None, skipped: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, how many each has) by agendas that are columns of one array: NEVER where no candidate is.

        Candidates are skipped by the draws of ``keys``, or, one of each unit, as ``skipped`` says (-1: none).
        A merged part stays where its first character was; ``after`` and ``before`` lead to its neighbours.
        """
        n, lengths = len(units), np.fromiter(map(len, units), np.int64, len(units))
        width = int(lengths.max())
        bits = (width + 1).bit_length()
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        part = np.full((width + 2, n), -1, np.int32)  # with a margin on both sides
        part[_within(lengths) + 1, np.repeat(np.arange(n), lengths)] = self.of_char[chars]
        agenda = np.full((width + 2, n), NEVER, np.int32)
        for at in range(1, width):
            place = self._places(part[at], part[at + 1])[1]
            agenda[at] = np.where(place < NEVER, place << bits | at, NEVER)
        column = np.arange(width + 2, dtype=np.int32)[:, None]
        after, before = (np.repeat(column + k, n, axis=1).ravel() for k in (1, -1))
        flat, live, number = part.ravel(), np.arange(n), 0
        while width > 1:
            best = agenda[1:width].min(axis=0)
            has = best < NEVER
            n_has = np.count_nonzero(has)
            if not n_has:
                break
            if n_has < 0.8 * len(live):
                live, agenda, best = live[has], agenda.compress(has, axis=1), best[has]
                has = np.ones(n_has, bool)
            m, queue = len(live), agenda.ravel()
            if keys is not None:
                skip = hashes(keys[live], np.array([number])) < self.limit
            else:
                skip = skipped[live] == number
            number += 1
            skip &= has
            gone = np.flatnonzero(skip)
            queue[(best[gone] & (1 << bits) - 1) * m + gone] = NEVER
            go = np.flatnonzero(has & ~skip)
            if not len(go):
                continue
            best, unit = best[go], live[go]
            at, piece = best & (1 << bits) - 1, self.at_place[best >> bits]
            here = at * n + unit
            right = after[here]
            there = right * n + unit
            tied = np.flatnonzero(piece < 0)
            if len(tied):
                piece[tied] = self.pair_ids[self._places(flat[here[tied]], flat[there[tied]])[0]]
            flat[here], flat[there] = piece, -1
            queue[right * m + go] = NEVER
            right, left = after[there], before[here]
            after[here], before[right * n + unit] = right, at
            _, place = self._places(np.concatenate([piece, flat[left * n + unit]]), np.concatenate([flat[right * n + unit], piece]))
            at = np.concatenate([at, left])
            queue[at * m + np.concatenate([go, go])] = np.where(place < NEVER, place << bits | at, NEVER)
        held = part.T >= 0
        return part.T[held], held.sum(axis=1)

    def merged_many(self, units: list[str], keys: np.ndarray | None = None, skipped: np.ndarray | None = None) -> list[list[int]]:
        """Ids of each unit; characters that are no piece lie beyond the ids."""
        if skipped is None:
            skipped = np.full(len(units), -1)
        ids, n_ids = self._merged(units, None if keys is None else keys.astype(np.uint64), skipped)
        return [x.tolist() for x in np.split(ids, np.cumsum(n_ids)[:-1])]

    def merged_long(self, unit: str, key: int) -> list[str]:
        """The same by an agenda in a heap."""
        rank, number = self.rank.get, 0
        parts: list[str] = list(unit)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[int, int, str]] = []
        # each merge offers two candidates at most, besides those at the start
        skip = (hashes(np.array([key], np.uint64), np.arange(3 * n)) < self.limit).tolist() if self.limit else [False] * (3 * n)

        def offer(at: int) -> None:
            if after[at] < n:
                pair = parts[at] + parts[after[at]]
                score = rank(pair)
                if score is not None:
                    heapq.heappush(agenda, (score, at, pair))

        for at in range(n - 1):
            offer(at)
        while agenda:
            score, at, pair = heapq.heappop(agenda)
            nxt = after[at]
            if not parts[at] or nxt >= n or parts[at] + parts[nxt] != pair:
                continue  # one of the two was merged meanwhile
            number += 1
            if skip[number - 1]:
                continue
            parts[at], parts[nxt] = pair, ""
            after[at] = after[nxt]
            if after[at] < n:
                before[after[at]] = at
            if before[at] >= 0:
                offer(before[at])
            offer(at)
        return [p for p in parts if p]

    def _spelled(self, ids: np.ndarray, n_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters beyond the ids in bytes; with the new numbers of ids."""
        beyond = np.flatnonzero(ids >= self.size)
        if not len(beyond):
            return ids, n_ids
        spelled = [self._in_bytes(chr(i - self.size)) for i in ids[beyond].tolist()]
        times = np.ones(len(ids), np.int64)
        times[beyond] = list(map(len, spelled))
        ends = np.cumsum(n_ids)
        whole = np.concatenate([[0], np.cumsum(times)])
        out = np.repeat(ids, times)
        out[np.repeat(whole[beyond], times[beyond]) + _within(times[beyond])] = list(chain.from_iterable(spelled))
        return out, whole[ends] - whole[ends - n_ids]

    def _by_length(self, units: list[str], keys: np.ndarray | None, skipped: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(which units, their ids, how many each has) of units of at most ``LONG`` characters, of like lengths together."""
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            own = [units[i] for i in some.tolist()]
            yield some, *self._merged(own, None if keys is None else keys[some], None if skipped is None else skipped[some])

    def _learn(self, units: list[str], skipped: np.ndarray) -> np.ndarray:
        """New states of these units, each with the candidate that is skipped in it (-1: none)."""
        out = np.zeros(len(units), np.int64)
        for some, ids, n_ids in self._by_length(units, None, skipped):
            own = [units[i] for i in some.tolist()]
            # every candidate is merged, and so makes one part less, or is skipped
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            draws = lengths - n_ids + (skipped[some] >= 0) if self.limit else skipped[some] + 1
            out[some] = self.states.add(own, skipped[some], *self._spelled(ids, n_ids), draws) + np.arange(len(some))
        return out

    def _drawn(self, state: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states in which occurrences end, by the draws of their keys; and which occurrences skip more than one candidate."""
        states, state = self.states, state.copy()
        live = np.arange(len(state))
        more = np.zeros(0, np.int64)
        for skips in range(2):
            at = state[live]
            n = states.draws.data[at]
            k, who = _within(n), np.repeat(np.arange(len(live)), n)
            skip = np.flatnonzero(hashes(keys[live][who], states.first.data[at][who] + k) < self.limit)
            skip = skip[np.diff(who[skip], prepend=-1) > 0]  # the first one of each occurrence
            who, k = who[skip], k[skip]
            if skips:
                more = live[who]
                break
            way = states.next_begin.data[at[who]] + k
            unknown, example = np.unique(way[states.next.data[way] < 0], return_index=True)
            if len(unknown):
                example = np.flatnonzero(states.next.data[way] < 0)[example]
                units = [states.units[b] for b in at[who[example]].tolist()]
                states.next.data[unknown] = self._learn(units, k[example])
            live = live[who]
            state[live] = states.next.data[way]
        return state, more

    def _own(self, units: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each occurrence begin, how many it has) by agendas of their own."""
        begin, number, kept, size = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), [np.zeros(0, np.int32)], 0
        for some, ids, n_ids in self._by_length(units, keys, None):
            ids, n_ids = self._spelled(ids, n_ids)
            begin[some], number[some] = size + np.cumsum(n_ids) - n_ids, n_ids
            kept.append(ids)
            size += len(ids)
        return np.concatenate(kept), begin, number

    def _own_agendas(self, units: list[str], keys: np.ndarray) -> list[list[int]]:
        """Ids of occurrences by agendas of their own."""
        ids, begin, number = self._own(units, keys)
        return [ids[b : b + n].tolist() for b, n in zip(begin.tolist(), number.tolist(), strict=True)]

    def _cut(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(different units, which one each occurrence is, how many occurrences each text has) of UTF-8 texts, null being empty."""
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        space = pa.scalar(b" ", pa.large_binary())
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(space, texts, pa.scalar(b"", pa.large_binary())))
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if not len(texts) or offsets[-1] == offsets[0]:
            return [], np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[: offsets[-1]]
        first = data == 32
        first[1:] &= data[:-1] != 32
        first[: offsets[0]] = False
        first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        # a white space sign of the text itself is spelled in bytes, so its parts are cut apart
        sign = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81))
        first[sign] = True
        first[sign[sign + 3 < len(data)] + 3] = True
        begin = np.flatnonzero(first)
        bounds = pa.py_buffer(np.append(begin, len(data)))
        found = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, bounds, texts.buffers()[2]]).dictionary_encode()
        units = [u.decode("utf-8", "surrogatepass") for u in found.dictionary.to_pylist()]
        units = [ESCAPED if u == SPACE else u.replace(" ", SPACE) for u in units]
        return units, found.indices.to_numpy().astype(np.int64), np.diff(np.searchsorted(begin, offsets))

    def encode_flat(self, texts: list[str] | pa.Array, keys: list[str], turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text begins and the last one ends)."""
        if len(self.states.units) > CACHE:
            self.states = States()
        states = self.states
        if ESCAPED not in states.of_unit:
            states.of_unit[ESCAPED] = states.add(
                [ESCAPED], np.array([-1]), np.array(self.escaped, np.int32), np.array([len(self.escaped)]), np.zeros(1, np.int64))
        if not isinstance(texts, pa.Array):
            texts = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
        units, which, n_units = self._cut(texts)
        known = np.fromiter((states.of_unit.get(u, -1) for u in units), np.int64, len(units))
        short = np.fromiter(map(len, units), np.int64, len(units)) <= LONG
        # without draws all occurrences are alike; of one that stands alone here nothing is kept
        new = np.flatnonzero((known < 0) & short & (np.bincount(which, minlength=len(units)) > (1 if self.limit else 0)))
        names = [units[i] for i in new.tolist()]
        known[new] = self._learn(names, np.full(len(new), -1))
        states.of_unit.update(zip(names, known[new].tolist(), strict=True))
        state, short = known[which], short[which]
        stream = np.zeros(len(which), np.uint64)
        own = np.zeros(0, np.int64)
        if self.limit:
            mine = [xxhash.xxh64_intdigest(f"{turn} {k}".encode("utf-8", "replace"), self.seed) for k in keys]
            stream = splitmix(np.repeat(np.array(mine, np.uint64), n_units) ^ splitmix(_within(n_units)))
            kept = np.flatnonzero(state >= 0)
            state[kept], more = self._drawn(state[kept], stream[kept])
            own = np.concatenate([kept[more], np.flatnonzero((state < 0) & short)])
        begin, n_ids, store = states.begin.data[state], states.n_ids.data[state].astype(np.int64), [states.ids.data]
        size = len(store[0])
        if len(own):  # ids behind those of the states
            ids, at, number = self._own([units[i] for i in which[own].tolist()], stream[own])
            begin[own], n_ids[own] = size + at, number
            store.append(ids)
            size += len(ids)
        for i in np.flatnonzero(~short).tolist():
            parts = self.merged_long(units[which[i]], int(stream[i]))
            ids = np.array([b for p in parts for b in ([self.ids[p]] if p in self.ids else self._in_bytes(p))], np.int32)
            begin[i], n_ids[i] = size, len(ids)
            store.append(ids)
            size += len(ids)
        ids = np.concatenate(store)[np.repeat(begin, n_ids) + _within(n_ids)]
        ends = np.concatenate([[0], np.cumsum(n_ids)])
        return ids, ends[np.concatenate([[0], np.cumsum(n_units)])]

    def encode_many(self, texts: list[str], keys: list[str], turn: int = 0) -> list[list[int]]:
        ids, ends = self.encode_flat(texts, keys, turn)
        return [x.tolist() for x in np.split(ids, ends[1:-1])] if texts else []

    def encode(self, text: str, key: str = "", turn: int = 0) -> list[int]:
        return self.encode_many([text], [key], turn)[0]

    def decode(self, ids: list[int]) -> str:
        try:
            joined = b"".join(map(self.bytes_of.__getitem__, ids))
        except IndexError:
            joined = b"".join(self.bytes_of[i] if 0 <= i < len(self.bytes_of) else b"\xff" for i in ids)
        return joined.decode("utf-8", "replace")[1:]  # without the white space that encoding put in front


def _encoder(path: str, dropout: float, seed: int) -> Pieces:
    """The vocabulary as loaded by this Python worker, with its cache."""
    key = (path, dropout, seed)
    if key not in _loaded:
        if len(_loaded) > 1:  # a worker may serve an encoder and a decoder in turn
            _loaded.clear()
        _loaded[key] = Pieces(path, dropout, seed)
    return _loaded[key]


_loaded: dict[tuple[str, float, int], Pieces] = {}


def _parts(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, list[str]]]:
    """(rows, texts, keys) of stretches of a batch of bounded size; columns at and at + 1 are text and key."""
    size = np.cumsum(np.concatenate([[0], pc.binary_length(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False)]))
    first = 0
    while first < batch.num_rows:
        end = min(max(int(np.searchsorted(size, size[first] + PART, side="right")) - 1, first + 1), batch.num_rows)
        part = batch.slice(first, end - first)
        yield part, part.column(at), [k or "" for k in part.column(at + 1).to_pylist()]
        first = end


def encoded(
    df: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL, dropout: float = DROPOUT,
    seed: int = SEED, turn: int = 0,
) -> DataFrame:
    """``df`` with ``piece_ids`` (array<int>) of the text."""
    kept = [c for c in df.columns if c != "piece_ids"]

    @freed_after
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _encoder(path, dropout, seed)
        try:
            for batch in batches:
                for part, texts, keys in _parts(batch, len(kept)):
                    ids, ends = pieces.encode_flat(texts, keys, turn)
                    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()), mask=texts.is_null())
                    yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], lists], [*kept, "piece_ids"])
        finally:
            pieces.states = States()  # Spark keeps the worker for other work

    given = df.select(*kept, df[text].alias("_text"), df[key].cast("string").alias("_key"))
    return given.mapInArrow(rows, with_fields(df.select(*kept), "piece_ids array<int>"))


def decoded(df: DataFrame, ids: str = "piece_ids", path: str = MODEL, name: str = "decoded") -> DataFrame:
    """``df`` with the text that the ids stand for: the bytes of each piece, joined inside the JVM."""
    every = F.split(F.lit(",".join(b.hex() for b in _encoder(path, 0.0, 0).bytes_of)), ",", -1)
    spelled = F.transform(F.col(ids).cast("array<int>"), lambda i: F.get(every, i))
    text = F.make_valid_utf8(F.unhex(F.array_join(spelled, "", "ff")).cast("string"))  # ff: ids of no piece
    # without the white space that encoding put in front
    return df.withColumn(name, F.substr(text, F.lit(2)))


def digest_rows(
    df: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL, dropout: float = DROPOUT,
    seed: int = SEED, turn: int = 0,
) -> DataFrame:
    """(key, piece_ids, n_pieces, piece_ids_sha256, decoded_sha256) of each row.

    The digests are those of the ids joined by commas and of the text that ``decoded`` makes of the ids.
    """
    both = decoded(encoded(df.select(key, text), text, key, path, dropout, seed, turn).drop(text), path=path)
    joined = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return both.select(
        key, "piece_ids", F.when(F.col("piece_ids").isNotNull(), F.size("piece_ids")).cast("bigint").alias("n_pieces"),
        F.sha2(joined, 256).alias("piece_ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op10_pieces(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digest_rows(docs)
