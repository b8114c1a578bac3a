"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sample text is built. A text is parsed against each automaton into phrases, each the longest match that starts where the
last phrase ended. Few phrases mean that the language's text explains this one; the phrase count times log2 of the sample's length, a character, estimates the
cross entropy, and the smallest wins. A character that a sample doesn't hold is a phrase that also has to be spelt out, at LITERAL bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vinlake.llm.common import as_table, draw_order, learns, map_texts

#: Documents of a language that are learnt from, each as a whole, and languages that one model holds: more of them are dealt out to several models, one after the other.
DOCS, LANGUAGES = 20, 100
#: Texts are parsed in blocks of so many characters side by side; what a block's parse takes over from the block before is then put right, so that counts are those of one parse.
BLOCK = 512
#: Blocks that are parsed at once.
WIDE = 4096
#: No language explains a text that takes more than FAR times the phrases of held-in text (its worse tenth), and ALLOWED more: in a short text a number or a name weighs much.
#: USUAL bits a character are granted at least, so that templates that fill a sample don't turn free text away. Held-in text is measured in pieces of PIECE characters.
FAR, ALLOWED, USUAL, PIECE = 1.75, 20, 3.5, 250
#: Bits that name one of all characters.
LITERAL = 20
#: Score from which on a predicted language overrules the given one: in check_s half of the right predictions score 0.43 or more, nine in ten 0.39 or more.
CONFIDENT = 0.4


def normal(text: str) -> str:
    """Lower case, with each run of characters that are no letters as one space: marks, digits and markup tell templates apart, not languages."""
    return _OTHER.sub(" ", text.lower()).strip()


_OTHER = re.compile(r"[\W\d_]+")


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The states' ways on, by character code; state 0 is the root."""
    maps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new, p = len(maps), last
        maps.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in maps[p]:
            maps[p][c] = new
            p = link[p]
        if p >= 0:
            q = maps[p][c]
            if length[q] > length[p] + 1:
                clone = len(maps)
                maps.append(dict(maps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and maps[p].get(c) == q:
                    maps[p][c] = clone
                    p = link[p]
                link[q] = q = clone
            link[new] = q
        last = new
    return maps


class Automaton:
    """A suffix automaton as one sparse array. Each state is a number of its own such that its way on by code c stands at `state + c`, as (state, next state) in 64
    bits; a place that another state owns, or none, means that there is no way. So any alphabet fits, at the size of the ways there are. Code 0, a character that no
    sample has, leads nowhere. DEAD has no way on: after it each next character starts a phrase."""

    def __init__(self, codes: list[int], alphabet: int):
        maps = suffix_automaton(codes)
        number = [0] * len(maps)
        owner: list[int] = [-1] * (4 * len(maps) + 4 * alphabet)
        taken, last = {0}, 0  # 0 is DEAD
        upto = [0] * (alphabet + 1)  # states of as many ways look for their places from here on: each place is tried once, at the cost of some that stay free
        for s in sorted(range(len(maps)), key=lambda s: -len(maps[s])):
            ways = sorted(maps[s])
            if not ways:
                continue  # as DEAD
            at = max(upto[len(ways)], ways[0] + 1)
            while owner[at] >= 0 or at - ways[0] in taken or any(owner[at - ways[0] + c] >= 0 for c in ways[1:]):
                at += 1
                if at + alphabet >= len(owner):
                    owner += [-1] * len(owner)
            number[s] = at - ways[0]
            upto[len(ways)] = at
            taken.add(number[s])
            for c in ways:
                owner[number[s] + c] = s
            last = max(last, number[s])
        self.ways = np.full(last + alphabet + 1, -1, np.int64)
        for s, m in enumerate(maps):
            for c, t in m.items():
                self.ways[number[s] + c] = number[s] << 32 | number[t]
        self.start, self.holds = np.zeros(alphabet + 1, np.int64), np.zeros(alphabet + 1, bool)
        for c, t in maps[0].items():
            self.start[c], self.holds[c] = number[t], True

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins."""
        way = self.ways[state + c]
        new = (way >> 32) != state
        return np.where(new, self.start[c], way & 0xFFFFFFFF), new

    def phrases(self, grid: np.ndarray, length: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block. grid: codes, a column a block; length: of each block; follows: the block before in the same text, -1 for a text's first block.

        Every block is parsed as if a phrase began with it. Then the phrase that runs into a block is followed until one begins where one begins in the block's own parse,
        from where on both agree. A block in which they never meet hands its new state on to the block after it.
        """
        n = len(length)
        order = np.argsort(-length, kind="stable")
        lengths, codes = length[order], grid[:, order]
        begins = np.zeros((int(length.max(initial=0)), n), bool)
        state, alive = np.zeros(n, np.int64), n
        for t in range(len(begins)):
            while lengths[alive - 1] <= t:
                alive -= 1
            state[:alive], begins[t, :alive] = self.step(state[:alive], codes[t, :alive])
        back = np.argsort(order, kind="stable")
        begins, end = begins[:, back], state[back]
        own, own_end = begins.sum(axis=0), end.copy()
        count, todo = own.copy(), np.flatnonzero(follows >= 0)
        next_of = np.full(n, -1)
        next_of[follows[todo]] = todo
        while len(todo):
            at, s, more, t = todo, end[follows[todo]], np.zeros(len(todo), np.int64), 0
            changed = []
            behind = np.zeros(len(todo), np.int64)  # phrases of the block's own parse up to here
            while len(at):
                over = t >= length[at]
                if over.any():  # the block ends before the parses meet
                    count[at[over]] = more[over]
                    moved = at[over][end[at[over]] != s[over]]
                    end[at[over]] = s[over]
                    changed.append(moved)
                    at, s, more, behind = at[~over], s[~over], more[~over], behind[~over]
                    if not len(at):
                        break
                s, new = self.step(s, grid[t, at])
                both = new & begins[t, at]
                count[at[both]] = more[both] + own[at[both]] - behind[both]
                changed.append(at[both][end[at[both]] != own_end[at[both]]])
                end[at[both]] = own_end[at[both]]
                more, behind = more + new, behind + begins[t, at]
                at, s, more, behind = at[~both], s[~both], more[~both], behind[~both]
                t += 1
            todo = next_of[np.concatenate([*changed, np.zeros(0, np.int64)]).astype(np.int64)]
            todo = todo[todo >= 0]
        return count


class Model:
    """The languages' automata. samples: language to sample text."""

    def __init__(self, samples: dict[str, str]):
        self.codes = {ch: i + 1 for i, ch in enumerate(sorted(set().union(*samples.values())))}
        self.languages = sorted(samples)
        self.automata = [Automaton(self._coded(samples[x]), len(self.codes)) for x in self.languages]
        self.bits = np.array([log2(max(2, len(samples[x]))) for x in self.languages])
        self.usual = np.array([self._usual(samples[x]) for x in self.languages])

    def parts(self) -> Iterator[Model]:
        yield self

    def _coded(self, text: str) -> list[int]:
        return [self.codes[ch] for ch in text]

    def _usual(self, sample: str) -> float:
        """Bits a character of held-in text: pieces of a sample's second half by the automaton of its first half, the worse tenth; USUAL at least. Infinite if the sample is too short."""
        codes = self._coded(sample)
        half = len(codes) // 2
        n = (len(codes) - half) // PIECE
        if not n:
            return np.inf
        grid = np.array(codes[half : half + n * PIECE]).reshape(n, PIECE).T
        found = Automaton(codes[:half], len(self.codes)).phrases(grid, np.full(n, PIECE), np.full(n, -1))
        return max(USUAL, float(np.quantile(found, 0.9)) * log2(max(2, half)) / PIECE)

    def strange(self, best: np.ndarray, low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of texts with their best language, its bits a character and their length: which ones it does not explain."""
        return low * sizes > FAR * self.usual[best] * sizes + ALLOWED * self.bits[best]

    def counter(self):
        """A function from (normal, not empty) texts to their phrases by language, and to the characters that a language's sample doesn't hold."""
        lookup = np.zeros(0x110000, np.int32)
        for ch, i in self.codes.items():
            lookup[ord(ch)] = i

        def counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            total, new = np.zeros((len(texts), len(self.automata))), np.zeros((len(texts), len(self.automata)))
            # A run of texts at once, of some WIDE blocks; the blocks of one text stay together.
            ends = np.cumsum([-(-len(t) // BLOCK) for t in texts])
            first = 0
            while first < len(texts):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + WIDE, side="right")))
                total[first:last], new[first:last] = some(texts[first:last])
                first = last
            return total, new

        def some(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            sizes = np.array([len(t) for t in texts], np.int64)
            codes = lookup[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
            blocks = -(-sizes // BLOCK)
            owner = np.repeat(np.arange(len(texts)), blocks)
            within = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            begin, length = (np.cumsum(sizes) - sizes)[owner] + within * BLOCK, np.minimum(BLOCK, sizes[owner] - within * BLOCK)
            follows = np.where(within > 0, np.arange(len(owner)) - 1, -1)
            grid = codes[np.minimum(begin[None, :] + np.arange(int(length.max()))[:, None], len(codes) - 1)]
            new = [np.add.reduceat(~a.holds[codes], np.cumsum(sizes) - sizes, dtype=np.int64) for a in self.automata]
            return np.stack([np.bincount(owner, a.phrases(grid, length, follows), len(texts)) for a in self.automata], axis=1), np.stack(new, axis=1)

        return counts

    def scorer(self):
        """A function from (normal, not empty) texts to their bits a character by language."""
        counts = self.counter()

        def rates(texts: list[str]) -> np.ndarray:
            found, new = counts(texts)
            return (found * self.bits + new * LITERAL) / np.array([len(t) for t in texts])[:, None]

        return rates


class Models:
    """More languages than one model holds, in the order of their names: each part is learnt when its turn comes, so the driver holds one at a time."""

    def __init__(self, rows: DataFrame, languages: list[str], purge: bool):
        self.rows, self.languages, self.purge = rows, languages, purge

    def parts(self) -> Iterator[Model]:
        for at in range(0, len(self.languages), LANGUAGES):
            yield _learnt(self.rows, self.languages[at : at + LANGUAGES], self.purge)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", purge: bool = False) -> Model | Models:
    """Learn from rows with a language and a text whose id may teach (crc32 mod 5 is not 0): whole texts, at most DOCS of each language (the first in a fixed
    pseudo-random order; repeated ones count once), of every language. Only these texts reach the driver, those of LANGUAGES languages at a time. purge: leave out texts that
    contradict their language (in favour of another of the same model) or that none explains, so that no text speaks for itself."""
    rows = df.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    rows = rows.filter(learns(F.col("i"), 5, 0) & F.col("l").isNotNull() & F.col("t").isNotNull())
    languages = sorted(r.l for r in rows.select("l").distinct().collect())  # names alone
    return _learnt(rows, languages, purge) if len(languages) <= LANGUAGES else Models(rows, languages, purge)


def _learnt(rows: DataFrame, languages: list[str], purge: bool) -> Model:
    """The model of some languages, from rows (i, t, l)."""
    rows = rows.filter(F.col("l").isin(languages))
    # The rank is taken over short rows; texts are fetched for the few that it leaves.
    short = rows.select("l", "i", F.xxhash64("t").alias("h")).withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy(*draw_order("i", "h"))))
    drawn = F.broadcast(short.filter(F.col("n") <= DOCS).select(F.col("l").alias("l2"), F.col("i").alias("i2"), F.col("h").alias("h2"), "n"))
    found = rows.join(drawn, (F.col("l") == F.col("l2")) & (F.col("i") == F.col("i2")) & (F.xxhash64("t") == F.col("h2"))).select("l", "n", "t").distinct()
    samples: dict[str, list[str]] = {}
    for lang, _, text in sorted(found.collect()):
        text = normal(text)
        if any(ch.isalpha() for ch in text) and text not in samples.setdefault(lang, []):
            samples[lang].append(text)
    samples = _purged(samples) if purge else samples
    return Model({lang: " ".join(parts) for lang, parts in samples.items() if parts})


def _purged(samples: dict[str, list[str]]) -> dict[str, list[str]]:
    """The texts without those that the other half of all texts doesn't explain, or confidently gives to another language."""
    halves = [Model({lang: " ".join(parts[k::2]) for lang, parts in samples.items() if parts[k::2]}) for k in (0, 1)]
    out = {lang: list(parts) for lang, parts in samples.items()}
    for k, other in enumerate(reversed(halves)):
        rates = other.scorer()
        for lang, parts in samples.items():
            if lang in other.languages and parts[k::2]:
                r = rates(parts[k::2])
                best, low = r.argmin(axis=1), r.min(axis=1)
                strange = other.strange(best, low, np.array([len(t) for t in parts[k::2]]))
                r[r == low[:, None]] = np.inf
                for text, b, sure, no in zip(parts[k::2], best, low <= (1 - CONFIDENT) * r.min(axis=1), strange):
                    if no or (sure and other.languages[b] != lang):
                        out[lang].remove(text)
    return out


def identify(df: DataFrame, model: Model | Models, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), reject: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, then the columns named in carry.

    lang_pred: the language of the least cross entropy (ties: the smaller name); `und` with score 0 if the text is null or has no letter, or nothing was learnt;
    with `reject`, also if no language explains the text: the winner takes more phrases than FAR and ALLOWED let it.
    score: by how much of it the runner-up's entropy exceeds the winner's, from 0 to 1. held_out: crc32 of the id mod 5 is 0; a null id is held out.
    """
    names = [f"c{i}" for i in range(len(carry))]
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (~learns(F.col(id_col), 5, 0)).alias("held_out"), F.col(text_col).cast("string").alias("t"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    carried = "".join(f", {n} {kinds[n]}" for n in names)
    kept = [F.col(n).alias(c) for c, n in zip(carry, names)]
    if isinstance(model, Models):
        # Model by model, with the best so far beside each row; a table between two of them, so that no task needs more than one model.
        found = rows.select("doc_id", "held_out", "t", *(F.lit(None).cast(k).alias(c) for c, k in _SO_FAR.items()), *names)
        for part in model.parts():
            found = as_table(map_texts(found, _better(df.sparkSession.sparkContext.broadcast(part)), "doc_id long, held_out boolean, t string, " + ", ".join(map(" ".join, _SO_FAR.items())) + carried, rows=512))
        no = F.col("best").isNull() | (F.col("strange") if reject else F.lit(False))
        score = F.greatest(F.lit(0.0), 1 - F.col("low") / F.col("after"))
        return found.select("doc_id", "held_out", F.when(no, "und").otherwise(F.col("best")).alias("lang_pred"), F.when(no, 0.0).otherwise(score).alias("score"), *kept)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: at most 3 ways on for each character of DOCS texts a language

    def make():
        model = shared.value
        rates = model.scorer()

        def fn(ids, held, texts, *rest):
            plain = [normal(t) if t else "" for t in texts]
            known = [i for i, t in enumerate(plain) if model.languages and any(map(str.isalpha, t))]
            pred, score = ["und"] * len(ids), [0.0] * len(ids)
            if known:
                r = rates([plain[i] for i in known])
                best = r.argmin(axis=1)
                low = r[np.arange(len(r)), best]
                sizes = np.array([len(plain[i]) for i in known])
                strange = reject & model.strange(best, low, sizes)
                r[np.arange(len(r)), best] = np.inf
                after = r.min(axis=1) if r.shape[1] > 1 else np.full(len(r), 2 * model.bits.max())
                for i, b, s, no in zip(known, best, np.clip(1 - low / after, 0, 1), strange):
                    if not no:
                        pred[i], score[i] = model.languages[b], float(s)
            return [ids, held, pred, score, *rest]

        return fn

    out = map_texts(rows, make, "doc_id long, held_out boolean, lang_pred string, score double" + carried, rows=512)
    return out.select("doc_id", "held_out", "lang_pred", "score", *kept)


#: Of a row the best language so far, its entropy, the runner-up's, and whether the best leaves the text unexplained.
_SO_FAR = {"best": "string", "low": "double", "after": "double", "strange": "boolean"}


def _better(shared):
    """map_texts: the rows with what one more model says."""

    def make():
        model = shared.value
        rates = model.scorer()

        def fn(ids, held, texts, best, low, after, strange, *rest):
            plain = [normal(t) if t else "" for t in texts]
            known = [i for i, t in enumerate(plain) if model.languages and any(map(str.isalpha, t))]
            if known:
                r = rates([plain[i] for i in known])
                first = r.argmin(axis=1)
                least = r[np.arange(len(r)), first]
                far = model.strange(first, least, np.array([len(plain[i]) for i in known]))
                r[np.arange(len(r)), first] = np.inf
                second = r.min(axis=1)
                for i, b, x, y, no in zip(known, first, least.tolist(), second.tolist(), far.tolist()):
                    if low[i] is None or x < low[i]:  # of equals the smaller name, which came before
                        after[i] = min(y, np.inf if low[i] is None else low[i])
                        best[i], low[i], strange[i] = model.languages[b], x, no
                    else:
                        after[i] = min(after[i], x)
            return [ids, held, texts, best, low, after, strange, *rest]

        return fn

    return make
