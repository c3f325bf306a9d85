"""The bit model behind scoring.py: binary codes, predictors, gated online mixing and an adaptive map.

A token is coded by binary events. If the text's last two tokens came before in it, one event says whether what followed
then follows again. If not, the path through a code tree names the token: its first node tells words of the alphabet from
all others, which are then spelled, letter by letter, by paths through a letter tree. Every event has predictors, each the
log-odds of counts of zeros and ones in its own context:

* a repeat: how long the text has been repeating itself; that and the word that would come again;
* a node of the word tree: the node alone; the node after the last frequent word;
* a node of the letter tree: the node after the last LENGTHS letters of the word, by a hash of both.

A gate (what kind of event, and how much is known of it) selects the weights that mix an event's log-odds. One more predictor
is the text itself: its own counts at the first steps of a path and the first letters of a word. What is mixed is refined by
an adaptive map: behind each gate, what became of such log-odds.

Each text starts with the weights fitted to all learning texts and an even map. All of its events, to the last step and
letter, move the weights of their gate, the share of the text's own counts and their level of the map: online, after each
block of tokens, by gradient over curvature. The mixer learns from its own errors, the map from those that are left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import chain, islice, repeat

import numpy as np

#: Bounds of a repeat's length in tokens, of an event's count, and of the letters known; they make the gates.
RUNS, TIMES = np.array([1, 2, 4, 16]), np.array([1, 2, 4, 16, 64, 256])
#: Letters that the letter predictors look back.
LENGTHS = (1, 2, 3, 5)
ORDERS = len(LENGTHS)
SLOT_BITS = 21
#: Gates: repeats, the first node, other nodes of the word tree, and nodes of the letter tree.
REPEAT, FIRST, INNER, LETTER = 0, len(RUNS) + 1, 2 * (len(RUNS) + 1), 2 * (len(RUNS) + 1) + len(TIMES) + 1
GATES = LETTER + 2 * (ORDERS + 1)
#: Added to counts before their log-odds are taken; how many sightings the wider context counts for in the narrower one.
PRIOR, WIDER = 0.2, 2.0
#: Tokens of a text after which weights and map move, doubling from the first to the last; and what weights and shares resist.
BLOCKS = (32, 1024)
INERTIA = 12.0
#: Letters that select the text's own counts, what those counts start from, and their first share.
OWN_LETTERS, OWN_PRIOR, OWN_SHARE = 2, 6.0, 0.7
#: Steps of a path in the word tree, and letters of a spelled word, that the text's own counts predict.
NEAR_STEPS, NEAR_LETTERS = 6, 2
#: Of the adaptive map: what a level resists, and levels from -TOP to TOP.
MAP_INERTIA, TOP = 40.0, 8
LEVELS = 2 * TOP + 1
#: The squares of an event's inputs together, as the weights' inertia takes them.
SQUARE = 8.0
#: Tokens whose events are worked on together.
TOGETHER = 8192
#: Events whose products are summed at once: short ones stay in a cache.
PRODUCT = 8192
#: Places up to which events are laid out place by place.
DEEP = 64
END = 32
#: A predictor's log-odds are kept in steps of 1 / ODDS, beside the gate; those of letters in steps of 1 / LETTER_ODDS.
ODDS, GATE_BITS, LETTER_ODDS = 32, 5, 12


class Tree:
    """A Huffman code: leaves in the order of a walk, so that every node covers a range of them."""

    def __init__(self, weights: np.ndarray, first: int | None = None):
        """first: a leaf that the root alone tells from all others."""
        n = len(weights)
        heap = [(max(float(w), 1e-3), k) for k, w in enumerate(weights.tolist()) if k != first]
        heapq.heapify(heap)
        left, right, made = {}, {}, n
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            left[made], right[made] = x, y
            heapq.heappush(heap, (a + b, made))
            made += 1
        root = heap[0][1] if heap else first
        if first is not None and heap:
            left[made], right[made] = root, first
            root = made
        paths: list[tuple] = [()] * n
        order, ranges, stack = [], [], [(root, (), ())]
        number: dict[int, int] = {}
        while stack:
            node, path, bits = stack.pop()
            if node < n:
                paths[node] = (path, bits)
                order.append(node)
                continue
            own = number[node] = len(number)
            stack.append((right[node], (*path, own), (*bits, 1)))
            stack.append((left[node], (*path, own), (*bits, 0)))
        self.nodes = max(1, len(number))
        self.length = np.array([len(p[0]) for p in paths], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.path = np.array([x for p in paths for x in p[0]], np.int64)
        self.bit = np.array([x for p in paths for x in p[1]], np.int8)
        self.order = np.array(order)
        # leaves of the left and of the right child of each node, as ranges of `order`
        place = np.empty(n, np.int64)
        place[self.order] = np.arange(n)
        self.low, self.mid, self.high = (np.full(self.nodes, v) for v in (n, n, 0))
        for leaf, (path, bits) in enumerate(paths):
            ranges += [(node, bit, place[leaf]) for node, bit in zip(path, bits, strict=True)]
        if ranges:
            node, bit, at = np.array(ranges).T
            np.minimum.at(self.low, node, at)
            np.minimum.at(self.mid, node[bit == 1], at[bit == 1])
            np.maximum.at(self.high, node, at + 1)

    def counts(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones at each node, of how often each leaf came."""
        upto = np.concatenate([[0], np.cumsum(leaves[self.order])])
        return upto[self.mid] - upto[self.low], upto[self.high] - upto[self.mid]


def ranged(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, value) of all values of the ranges, one range after another."""
    of = np.repeat(np.arange(len(starts)), sizes)
    return of, np.arange(len(of)) + (starts - (np.cumsum(sizes) - sizes)).take(of)


def log_odds(zeros: np.ndarray, ones: np.ndarray, prior_zeros: np.ndarray | float = PRIOR, prior_ones: np.ndarray | float = PRIOR) -> np.ndarray:
    return np.log((ones + prior_ones) / (zeros + prior_zeros)).astype(np.float32)


def narrowed(zeros: np.ndarray, ones: np.ndarray, wider: np.ndarray) -> np.ndarray:
    """Log-odds of counts on top of WIDER sightings that follow the wider context's log-odds."""
    p = sigmoid(wider)
    return log_odds(zeros, ones, WIDER * (1 - p), WIDER * p)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


Events = Iterable[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def packed(mixed: np.ndarray, gate: np.ndarray) -> np.ndarray:
    return (np.clip(np.rint(mixed * ODDS), -1000, 1000).astype(np.int16) << GATE_BITS) | gate.astype(np.int16)


def newton_sums(weights: np.ndarray, events: Events) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of each gate's weights, over events of (inputs (inputs, events), gate, bit, times)."""
    slope, bend = np.zeros(weights.shape), np.zeros((*weights.shape, weights.shape[1]))
    for x, gate, bit, times in events:
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        ends = np.searchsorted(gate[order], np.arange(len(weights) + 1))
        for g, low in [(g, low) for g in np.nonzero(np.diff(ends))[0] for low in range(ends[g], ends[g + 1], PRODUCT)]:
            at = order[low : min(low + PRODUCT, ends[g + 1])]
            own = np.concatenate([x.take(at, axis=1), np.ones((1, len(at)), np.float32)])
            p = sigmoid(weights[g].astype(np.float32) @ own)
            n = times.take(at).astype(np.float32)
            slope[g] += own @ ((bit.take(at) - p) * n)
            bend[g] += (own * (p * (1 - p) * n)) @ own.T
    return slope, bend


def newton_step(weights: np.ndarray, slope: np.ndarray, bend: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Weights after one step; a gate that has seen little stays near the start."""
    hold = 4.0 * np.eye(weights.shape[1])
    step = np.linalg.solve(bend + hold, (slope - 4.0 * (weights - start))[:, :, None])[:, :, 0]
    return np.clip(weights + np.clip(step, -1, 1), -3, 4)


def node_events(tree: Tree, pairs: np.ndarray) -> Iterator[tuple]:
    """Events of the word tree over (contexts, leaves) counts, each with its own sighting left out of its context.

    It stays in the counts of the node alone: the tree is built of these, so that without it a node would tell what came.
    """
    zeros, ones = tree.counts(pairs.sum(axis=0))
    for own in pairs:
        if own.any():
            n0, n1 = tree.counts(own)
            for bit, times in ((0, n0), (1, n1)):
                at = np.nonzero(times)[0]
                b0, b1 = n0[at] - (bit == 0), n1[at] - (bit == 1)
                x = log_odds(zeros[at], ones[at])
                yield np.stack([x, narrowed(b0, b1, x)]), node_gate(at, b0 + b1), np.full(len(at), bit), times[at]


def node_gate(node: np.ndarray, times: np.ndarray) -> np.ndarray:
    rank = np.searchsorted(TIMES, times, side="right")
    return np.where(node == 0, FIRST + np.minimum(rank, len(RUNS)), INNER + rank)


def repeat_events(counts: np.ndarray) -> Iterator[tuple]:
    """Events of repeats over counts (runs, leaves, miss or hit), each with its own sighting left out."""
    total = counts.sum(axis=1)
    for run in range(len(counts)):
        at = np.nonzero(counts[run].any(axis=1))[0]
        for bit in (0, 1):
            left = np.array([bit == 0, bit == 1])
            wide, own = total[run] - left, counts[run][at] - left
            x = np.full(len(at), log_odds(*np.maximum(wide, 0)), np.float32)
            yield np.stack([x, narrowed(*np.maximum(own, 0).T, x)]), np.full(len(at), REPEAT + run), np.full(len(at), bit), counts[run][at][:, bit]


def spelled(words: list[bytes]) -> tuple[np.ndarray, ...]:
    """(letters with an end after each word, hashes (ORDERS, letters) of the last letters before each, index of its word, its place there)."""
    data = np.frombuffer(b"".join([w + b" " for w in words]), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    of = np.repeat(np.arange(len(words)), sizes)
    depth = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes, own = np.empty((ORDERS, len(data)), np.uint32), np.zeros(len(data), np.uint32)
    for back in range(1, LENGTHS[-1] + 1):
        # in front of a word stand ends
        past = np.full(len(data), END, np.uint32)
        past[back:] = data[:-back]
        past[depth < back] = END
        own = (own ^ (past + np.uint32(back << 8))) * np.uint32(0x9E3779B1)
        own = own ^ (own >> np.uint32(15))
        if back in LENGTHS:
            hashes[LENGTHS.index(back)] = own
    return data, hashes, of, depth


def letter_cells(tree: Tree, words: list[bytes]) -> tuple[np.ndarray, ...]:
    """(index of the word, bit, cells (ORDERS, events), place of the letter) of every event of the words' letters."""
    data, hashes, word, depth = spelled(words)
    of, at = ranged(tree.offset.take(data), tree.length.take(data))
    cells = np.empty((ORDERS, len(of)), np.int64)
    stepped = ((tree.path.astype(np.uint32) + np.uint32(1)) * np.uint32(0x85EBCA6B)).take(at)
    for k in range(ORDERS):
        # much faster than to repeat so few times
        own = hashes[k].take(of)
        own ^= stepped
        own *= np.uint32(0xC2B2AE35)
        own >>= np.uint32(32 - SLOT_BITS)
        cells[k] = own
    return word.take(of), tree.bit.take(at), cells, depth.take(of)


_LOGS = np.log(np.arange(1 << 16) + PRIOR).astype(np.float32)


def letter_events(tree: Tree, counts: np.ndarray, words: list[bytes], times: np.ndarray) -> Iterator[tuple]:
    """Events of spelled words; a word that came once is left out of the counts (ORDERS, slots, zeros and ones)."""
    word, bit, cells, _ = letter_cells(tree, words)
    once = (times == 1).astype(np.int32).take(word)
    more = once * bit
    less = once - more
    x, best = np.empty((ORDERS, len(bit)), np.float32), np.zeros(len(bit), np.int32)
    known, top = np.zeros(len(bit), np.int32), len(_LOGS) - 1
    for k in range(ORDERS):
        # both counts lie side by side
        both = counts[k].view(np.uint64).ravel().take(cells[k]).view(np.int32)
        zeros, ones = both[::2] - less, both[1::2] - more
        x[k] = _LOGS.take(np.minimum(ones, top)) - _LOGS.take(np.minimum(zeros, top))
        seen = zeros + ones
        met = seen > 0
        known += met
        # whether the longest order that knows the event has met it often
        best = np.maximum(best, met * (2 * k + 2 + (seen >= 8)))
    yield x, LETTER + 2 * known + (best & 1), bit, times.take(word)


def starting_weights(size: int) -> np.ndarray:
    """Weights of `size` inputs, the wider context before the narrower one, and of a constant."""
    w = np.zeros((GATES, size + 1))
    if size == 2:
        w[:, :2] = 0.3, 0.7
    else:
        # the longest contexts that know the event
        for gate in range(LETTER, GATES):
            known = (gate - LETTER) // 2
            for back, share in enumerate((0.4, 0.35, 0.15)):
                if known > back:
                    w[gate, known - 1 - back] = share
    return w


def _letter_gates() -> np.ndarray:
    """The gate of each way in which the orders, two bits for each, know an event: whether it came, and whether often."""
    met = np.arange(1 << 2 * ORDERS)
    known, best = np.zeros(len(met), np.int64), np.zeros(len(met), np.int64)
    for k in range(ORDERS):
        came, often = met >> 2 * k & 1, met >> 2 * k + 1 & 1
        known += came
        # whether the longest order that knows the event has met it often
        best = np.maximum(best, came * (2 * k + 2 + often))
    return (LETTER + 2 * known + (best & 1)).astype(np.uint8)


_GATES = _letter_gates()


class Own:
    """The texts' own counts of zeros and ones: eight hashed cells a token."""

    def __init__(self, sizes: np.ndarray):
        room = 1 << np.ceil(np.log2(8 * sizes)).astype(np.int64)
        self.first, self.mask = np.cumsum(room) - room, room - 1
        self.counts = np.zeros((room.sum(), 2), np.float32)

    def cells(self, owner: np.ndarray, key: np.ndarray) -> np.ndarray:
        return self.first.take(owner) + (((key * 0x9E3779B1) >> 7) & self.mask.take(owner))

    def take(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.counts.view(np.int64).ravel().take(cells).view(np.float32)
        return both[::2], both[1::2]

    def add(self, cells: np.ndarray, bit: np.ndarray) -> None:
        np.add.at(self.counts.ravel(), cells * 2 + bit, np.float32(1))


class Model:
    """What scoring needs: for each event its gate and the log-odds of its predictors, from tables, and the weights to start from."""

    def __init__(self, size: int, classes: int, counts: np.ndarray):
        """counts: those of add_situations() over all learning texts, for an alphabet of `size` words."""
        pairs = counts[: (classes + 1) * (size + 1)].reshape(classes + 1, size + 1)
        repeats = counts[pairs.size :].reshape(len(RUNS) + 1, size + 1, 2)
        self.classes, self.other = classes, size
        self.tree = Tree(pairs.sum(axis=0), first=self.other)
        start = starting_weights(2)
        weights = start
        for _ in range(4):
            sums = [newton_sums(weights, f) for f in (node_events(self.tree, pairs), repeat_events(repeats))]
            weights = newton_step(weights, sums[0][0] + sums[1][0], sums[0][1] + sums[1][1], start)
        self.weights = weights
        zeros, ones = self.tree.counts(pairs.sum(axis=0))
        nodes = np.arange(self.tree.nodes)
        self.alone = log_odds(zeros, ones)
        self.steps = (self.tree.path << 1 | self.tree.bit).astype(np.int32)
        # a node's contexts lie side by side: few nodes, those near the root, are asked for most
        self.named = np.empty((self.tree.nodes, len(pairs)), np.int16).T
        for c, own in enumerate(pairs):
            n0, n1 = self.tree.counts(own)
            self.named[c] = packed(narrowed(n0, n1, self.alone), node_gate(nodes, n0 + n1))
        total = repeats.sum(axis=1)
        self.went_on = log_odds(total[:, 0], total[:, 1])
        x = np.broadcast_to(self.went_on[:, None], repeats.shape[:2])
        self.again = packed(narrowed(repeats[..., 0], repeats[..., 1], x), np.broadcast_to(REPEAT + np.arange(len(repeats))[:, None], x.shape))

    def with_letters(self, tree: Tree, counts: np.ndarray, weights: np.ndarray) -> None:
        self.letter_tree, self.letter_weights = tree, weights.astype(np.float32)
        zeros, ones = counts[..., 0], counts[..., 1]
        # log-odds in steps, whether it came eight times, whether it came
        odds = np.clip(np.rint(log_odds(zeros, ones) * LETTER_ODDS), -127, 127).astype(np.int16)
        seen = zeros + ones
        self.letters = (odds << 2) | ((seen >= 8).astype(np.int16) << 1) | (seen > 0)

    def spell(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """(first event of each word and after the last, how many events are near, log-odds (events, ORDERS) in steps, gates and bits, cells of the text's own counts)."""
        word, bit, cells, letter = letter_cells(self.letter_tree, words)
        odds, met = np.empty((len(bit), ORDERS), np.int8), np.zeros(len(bit), np.uint8)
        for k in range(ORDERS):
            found = self.letters[k].take(cells[k])
            odds[:, k] = found >> 2
            met |= (found & 3).astype(np.uint8) << np.uint8(2 * k)
        first = np.searchsorted(word, np.arange(len(words) + 1))
        near = np.bincount(word[letter < NEAR_LETTERS], minlength=len(words))
        return first, near, odds, _GATES.take(met) << np.uint8(1) | bit.view(np.uint8), cells[OWN_LETTERS - 1]

    def flat(self, texts: list[list[bytes]], known: dict[bytes, int]) -> dict:
        """flattened() texts, whose spelled words are remembered until the next call, and those of `known` as long as it is the same."""
        memory = self.__dict__.get("memory")
        if memory is None or memory.known is not known:
            memory = self.memory = Spelled(known, self.other)
        found = flattened(texts, known, self.other, self.classes)
        memory.add(self, found["word"].take(found["far"]), found["fresh"])
        return found

    def costs(self, flat: dict) -> np.ndarray:
        """Bits of each text of flat()."""
        starts, sizes = flat["starts"], flat["sizes"]
        named, spelled = Online(self.weights[:LETTER], sizes), Online(self.letter_weights[LETTER:], sizes)
        at, block = 0, BLOCKS[0]
        while (live := np.nonzero(sizes > at)[0]).size:
            many = np.minimum(sizes[live] - at, block)
            # a few texts at a time, so that their events fit a cache
            step = (np.cumsum(many) - many) // TOGETHER
            for texts, n in zip(*(np.split(x, np.nonzero(np.diff(step))[0] + 1) for x in (live, many)), strict=True):
                of, token = ranged(starts[texts] + at, n)
                # the texts take turns: sums go faster if the next value is for another cell
                turn = np.argsort((token - (starts[texts] + at).take(of)).astype(np.uint16), kind="stable")
                token, text = token.take(turn), texts.take(of.take(turn))
                tried = flat["guess"].take(token) >= 0
                left = ~(tried & flat["hit"].take(token))
                asked, tried, token, text = text[tried], token[tried], token[left], text[left]
                symbol = flat["symbol"].take(token)
                named.block(*self._paths(flat, token, symbol, text, tried, asked, named.own), texts[0], texts[-1] + 1)
                far = symbol == self.other
                if far.any():
                    spelled.block(*self._letters(flat["word"].take(token[far]), text[far], spelled.own), texts[0], texts[-1] + 1)
            at, block = at + block, min(2 * block, BLOCKS[1])
        return named.bits + spelled.bits

    def _paths(self, flat: dict, token: np.ndarray, symbol: np.ndarray, text: np.ndarray, tried: np.ndarray, asked: np.ndarray, own: Own) -> tuple:
        """Events for Online.block(): repeats that were tried (asked: their texts), and the tokens' paths in the word tree."""
        run, again = flat["run"].take(tried), flat["hit"].take(tried)
        context = flat["context"].take(token)
        at, depths, (owner, context) = laid(self.tree.offset.take(symbol), self.tree.length.take(symbol), text, context)
        step = self.steps.take(at)
        node = step >> 1
        both = np.concatenate([self.again[run, flat["guess"].take(tried)], self.named.T.ravel().take(node * np.int64(len(self.named)) + context)])
        inputs = [np.concatenate([self.went_on.take(run), self.alone.take(node)]), (both >> GATE_BITS) * np.float32(1 / ODDS)]
        near = sum(depths[:NEAR_STEPS])
        owner = np.concatenate([asked, owner])
        cells = own.cells(owner[: len(run) + near], np.concatenate([run, node[:near] + 8]))
        return inputs, both & ((1 << GATE_BITS) - 1), owner, np.concatenate([again.view(np.int8), (step & 1).astype(np.int8)]), slice(0, len(cells)), cells

    def _letters(self, word: np.ndarray, text: np.ndarray, own: Own) -> tuple:
        """Events for Online.block(): the letters of spelled words."""
        odds, gates, cells = self.memory.events
        start = self.memory.first.take(word)
        event, _, (owner, near) = laid(start, self.memory.size.take(word), text, start + self.memory.near.take(word))
        x = odds.view(np.int32).ravel().take(event).view(np.int8).reshape(-1, ORDERS).T.astype(np.float32, order="C")
        x *= np.float32(1 / LETTER_ODDS)
        both = gates.take(event)
        near = np.nonzero(event < near)[0]
        return list(x), (both >> 1) - np.uint8(LETTER), owner, (both & 1).view(np.int8), near, own.cells(owner.take(near), cells.take(event.take(near)) - np.int64(1 << SLOT_BITS))


def laid(starts: np.ndarray, sizes: np.ndarray, *of: np.ndarray) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """(value, how many at each place, the range's entry in each of `of`) of the ranges' values: all first ones, all second ones, and so on.

    Those from place DEEP on come range after range.
    """
    order = np.argsort(np.uint16(DEEP) - np.minimum(sizes, DEEP).astype(np.uint16), kind="stable")
    starts, sizes, *of = (x.take(order) for x in (starts, sizes, *of))
    short = np.minimum(sizes, DEEP)[::-1]
    depths = (len(short) - np.searchsorted(short, np.arange(short.max(initial=0)), side="right")).tolist()
    deep, value = ranged(starts + DEEP, np.maximum(sizes - DEEP, 0)) if len(depths) == DEEP else (order[:0], order[:0])
    return (
        np.concatenate([*(starts[:n] + k for k, n in enumerate(depths)), value]),
        depths,
        [np.concatenate([*(x[:n] for n in depths), x.take(deep)]) for x in of],
    )


def missed(sign: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slope of the log-odds y towards what came, its bend, one over the probability of what came).

    After an error the bend is no less than half the chance given to it, so that a step away from a sure error is not too long.
    """
    wrong = sign * y
    np.negative(wrong, out=wrong)
    np.exp(np.clip(wrong, -20, 20, out=wrong), out=wrong)
    both = 1 + wrong
    wrong /= both
    bend = 1 - wrong
    np.maximum(bend, np.float32(0.5), out=bend)
    bend *= wrong
    wrong *= sign
    return wrong, bend, both


class Online:
    """Each text's weights, own counts, shares and adaptive map for events of some gates. They move after each block()."""

    def __init__(self, weights: np.ndarray, sizes: np.ndarray):
        """weights: (gates, inputs and a constant) that each text starts from; sizes: tokens of the texts."""
        self.gates, self.own, size = len(weights), Own(sizes), len(sizes) * len(weights)
        self.bits = np.zeros(len(sizes))
        self.weights = np.tile(weights.T.astype(np.float32), (1, len(sizes)))
        self.held, self.held_share = np.full(size, INERTIA * SQUARE), np.full(size, INERTIA)
        self.share = np.full(size, OWN_SHARE, np.float32)
        self.map, self.held_map = np.zeros(size * LEVELS, np.float32), np.full(size * LEVELS, MAP_INERTIA, np.float32)

    def block(self, inputs: list[np.ndarray], gate: np.ndarray, owner: np.ndarray, bit: np.ndarray, near: slice | np.ndarray, local: np.ndarray, low: int, high: int) -> None:
        """Add up the bits of events of the texts from low to high - 1, then learn from them.

        near: the events that have own counts; local: the cells of these.
        """
        size = (high - low) * self.gates
        cells, levels = slice(low * self.gates, high * self.gates), slice(low * self.gates * LEVELS, high * self.gates * LEVELS)
        weights, held, share, held_share = self.weights[:, cells], self.held[cells], self.share[cells], self.held_share[cells]
        refined, held_map = self.map[levels], self.held_map[levels]
        owner = owner - low
        cell = owner * self.gates + gate
        y = weights[-1].take(cell)
        for w, x in zip(weights, inputs, strict=False):
            y += w.take(cell) * x
        np.clip(y, -20, 20, out=y)
        # log-odds of the text's own counts on top of OWN_PRIOR sightings that follow y, less y
        known, by = y[near], cell[near]
        odds = np.exp(known)
        both = 1 + odds
        zeros, ones = self.own.take(local)
        news = np.log((ones * both + OWN_PRIOR * odds) / (zeros * both + OWN_PRIOR)) - known
        y[near] = known + share.take(by) * news
        sign = (2 * bit - 1).astype(np.float32)
        miss, bend, _ = missed(sign, y)
        slopes = [np.bincount(cell, miss * x, size) for x in inputs]
        slopes.append(np.bincount(cell, miss, size))
        norm = 1 + inputs[0] * inputs[0]
        for x in inputs[1:]:
            norm += x * x
        held += np.bincount(cell, bend * norm, size)
        for w, slope in zip(weights, slopes, strict=True):
            w += slope / (2 * held)
        held_share += np.bincount(by, bend[near] * news * news, size)
        share += np.bincount(by, miss[near] * news, size) / held_share
        np.clip(share, 0, 2, out=share)
        # the adaptive map: what became of such log-odds behind the same gate
        level = np.rint(np.clip(y, -TOP, TOP)).astype(np.int64) + (cell * LEVELS + TOP)
        y += refined.take(level)
        miss, bend, inverse = missed(sign, y)
        self.bits[low:high] += np.bincount(owner, np.log(inverse), high - low) * (1 / np.log(2))
        held_map += np.bincount(level, bend, size * LEVELS)
        refined += np.bincount(level, miss, size * LEVELS) / held_map
        self.own.add(local, bit[near])


class Spelled:
    """What Model.spell() gave: of known words outside the alphabet, from when they first came; of all others, until the next add()."""

    def __init__(self, known: dict[bytes, int], size: int):
        """size: of the alphabet, whose words stand first."""
        self.known, self.words = known, list(islice(known, size, None))
        self.kept = len(self.words)
        self.first, self.size, self.near = (np.zeros(self.kept, np.int64) for _ in range(3))
        self.met, self.upto = np.zeros(self.kept, bool), 0
        self.events = [np.zeros((0, ORDERS), np.int8), np.zeros(0, np.uint8), np.zeros(0, np.int32)]

    def add(self, model: Model, places: np.ndarray, fresh: list[bytes]) -> None:
        """Words that came: those at these places, of which the fresh ones stand after all known ones."""
        places = places[places < self.kept]
        new = np.unique(places[~self.met.take(places)])
        start, many = self.upto, len(new) + len(fresh)
        if not many:
            return
        first, near, *events = model.spell([*map(self.words.__getitem__, new.tolist()), *fresh])
        at = np.concatenate([new, np.arange(self.kept, self.kept + len(fresh))])
        self.first, self.size, self.near = (grown(x, self.kept + len(fresh)) for x in (self.first, self.size, self.near))
        self.first[at], self.size[at], self.near[at] = start + first[:-1], np.diff(first), near
        self.met[new] = True
        self.upto += int(first[len(new)])
        for k, own in enumerate(events):
            self.events[k] = grown(self.events[k], start + len(own))
            self.events[k][start : start + len(own)] = own


def grown(values: np.ndarray, size: int) -> np.ndarray:
    """With room for more; what is not written yet takes no memory."""
    if size <= len(values):
        return values
    out = np.zeros((max(size, 2 * len(values)), *values.shape[1:]), values.dtype)
    out[: len(values)] = values
    return out


def flattened(texts: list[list[bytes]], known: dict[bytes, int], size: int, classes: int) -> dict:
    """Of all tokens: symbol, context, guess (symbol of what came last after the same two tokens, or -1), hit, run, word.

    starts: the first token of each text; known: numbers of words, below `size` those of the alphabet, others from size + 1 on;
    word: the place among the latter, after which the fresh ones stand, that are not known; far: the tokens outside the alphabet.
    """
    tokens = list(chain.from_iterable(texts))
    unique = np.fromiter(map(known.get, tokens, repeat(-1)), np.int64, len(tokens))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(texts)), sizes)
    fresh: dict[bytes, int] = {}
    add, after = fresh.setdefault, max(len(known), size) + 1
    new = np.nonzero(unique < 0)[0]
    unique[new] = [add(tokens[k], after + len(fresh)) for k in new.tolist()]
    far = np.nonzero(unique > size)[0]
    symbol, word = np.minimum(unique, size), np.maximum(unique - (size + 1), 0)
    # the last frequent word before each token, of the same text
    place = np.arange(len(symbol))
    last = np.maximum.accumulate(np.where(symbol < classes, place, -1))
    last = np.concatenate([[-1], last[:-1]])
    context = np.where(last >= starts[of], symbol[last], classes)
    # the last place with the same two tokens before it
    guess, run = np.full(len(symbol), -1), np.zeros(len(symbol), np.int64)
    hit = np.zeros(len(symbol), bool)
    two = np.nonzero(place - starts[of] >= 2)[0]
    if len(two):
        width = np.uint64(len(symbol).bit_length())
        key = (unique[two - 2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (unique[two - 1].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        key = (key ^ (key >> np.uint64(29))) + of[two].astype(np.uint64) * np.uint64(0x165667B19E3779F9)
        # places of equal hashes stand together and in order
        key = np.sort(((key * np.uint64(0x9E3779B97F4A7C15)) >> width << width) | two.astype(np.uint64))
        order = (key & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
        same = (key[1:] >> width) == (key[:-1] >> width)
        again, source = order[1:][same], order[:-1][same]
        guess[again] = symbol[source]
        hit[again] = unique[source] == unique[again]
        # how many hits in a row end before a token
        broken = np.where(hit, -1, place)
        until = np.maximum.accumulate(broken)
        length = np.concatenate([[0], (place - until)[:-1]])
        run = np.searchsorted(RUNS, np.where(place == starts[of], 0, length), side="right")
    return {"far": far, "sizes": sizes, "starts": starts, "fresh": list(fresh), "tokens": tokens, "symbol": symbol, "context": context, "guess": guess, "hit": hit, "run": run, "word": word}


def add_situations(counts: np.ndarray, texts: list[list[bytes]], alphabet: dict[bytes, int], classes: int) -> None:
    """Count pairs (class before, symbol) and repeats (run, symbol, miss or hit), one after the other, as Model takes them."""
    flat, n = flattened(texts, alphabet, len(alphabet), classes), len(alphabet) + 1
    tried, hit = flat["guess"] >= 0, flat["hit"]
    named = ~(tried & hit)
    np.add.at(counts, flat["context"][named] * n + flat["symbol"][named], np.uint32(1))
    np.add.at(counts, (classes + 1) * n + (flat["run"][tried] * n + flat["guess"][tried]) * 2 + hit[tried], np.uint32(1))


def situations(size: int, classes: int) -> int:
    """Cells that add_situations() counts in."""
    return (classes + 1 + 2 * (len(RUNS) + 1)) * (size + 1)


def letter_frequencies(words: list[bytes]) -> np.ndarray:
    return np.bincount(np.frombuffer(b"".join([w + b" " for w in words]), np.uint8), minlength=256) if words else np.zeros(256, np.int64)


def add_letters(counts: np.ndarray, tree: Tree, words: list[bytes]) -> None:
    """Counts (ORDERS, slots, zeros and ones) of each word's letters, once for each word."""
    _, bit, cells, _ = letter_cells(tree, words)
    for k in range(ORDERS):
        np.add.at(counts[k].ravel(), cells[k] * 2 + bit, np.uint32(1))
