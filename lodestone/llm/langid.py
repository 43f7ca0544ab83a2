"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text is built. A text is parsed against each of them
from left to right into longest matches: the language that needs the fewest phrases per character
wins. The automata's transitions are sparse (rows of one table, displaced so that they interlock), with no limit on
the alphabet. Many places are parsed side by side, a character a step: a long text is begun in many places at once, and each
stretch is then parsed again from the true state of the one before it, until both parses begin a phrase at
the same character. From there on they are one, so that the result is that of one parse of the whole text.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import python_batches, table

#: Bounds of the training sample of a language: documents, characters of all, and the longest document that may be sampled.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_LONGEST = 64, 32_768, 1 << 20
#: Characters of a stretch, and of texts parsed at a time (a bound on memory; it has no effect on results).
STRETCH, AT_ONCE = 512, 1 << 20
UNDETERMINED = "und"
#: A text is foreign if its best language's excess (phrases beyond those usual in it, by character; 0 to 1) is above this.
FOREIGN = 0.6


@lru_cache(maxsize=1)
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form, with all that isn't a letter as a space, and whether it is a letter."""
    lower, letter = np.full(sys.maxunicode + 1, 32, np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            low = c.lower()
            lower[i] = ord(low) if len(low) == 1 else i
    return lower, letter


def letters(text: str) -> np.ndarray:
    """The text's folded code points: letters in lower case, and one space for each run of anything else."""
    lower, _ = _folded()
    folded = lower[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = folded == 32
    return folded[~(space & np.concatenate(([True], space[:-1])))]


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings: for each state {symbol: state}. The root is state 1, state 0 has none."""
    steps: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for c in symbols.tolist():
        now = len(steps)
        steps.append({})
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and c not in steps[p]:
            steps[p][c] = now
            p = link[p]
        if p:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return steps


def displaced(steps: list[dict[int, int]], n_symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target) of a transition table: state s goes by symbol c to target[base[s] + c] if owner[base[s] + c] is s.

    Rows are put where they meet no other row's entries, large ones first; those of one entry fill the holes.
    """
    edges = sum(map(len, steps))
    base = np.zeros(len(steps), np.int32)
    owner, target = np.full(2 * edges + 2 * n_symbols + 64, -1, np.int32), np.zeros(2 * edges + 2 * n_symbols + 64, np.int32)
    many = sorted((s for s, row in enumerate(steps) if len(row) > 1), key=lambda s: (-len(steps[s]), s))
    start = n_symbols  # below it no base would be positive
    for s in many:
        row = np.array(sorted(steps[s].items()), np.int64)
        at, width = start, 64
        while True:
            while at + width + n_symbols >= len(owner):
                owner, target = np.append(owner, np.full(len(owner), -1, np.int32)), np.append(target, np.zeros(len(target), np.int32))
            free = at + np.flatnonzero(owner[at : at + width] < 0)
            fits = np.flatnonzero((owner[(free - row[0, 0])[:, None] + row[:, 0]] < 0).all(axis=1)) if len(free) else free
            if len(fits):
                break
            at += width
        start = at  # holes before it are left to rows of one entry
        base[s] = free[fits[0]] - row[0, 0]
        owner[base[s] + row[:, 0]], target[base[s] + row[:, 0]] = s, row[:, 1]
    one = np.array([(s, *next(iter(row.items()))) for s, row in enumerate(steps) if len(row) == 1], np.int64).reshape(-1, 3)
    free = n_symbols + np.flatnonzero(owner[n_symbols:] < 0)
    if len(free) < len(one) + n_symbols:
        extra = np.arange(len(owner), len(owner) + len(one) + n_symbols)
        owner, target, free = np.append(owner, np.full(len(extra), -1, np.int32)), np.append(target, np.zeros(len(extra), np.int32)), np.append(free, extra)
    free = free[: len(one)]
    base[one[:, 0]] = free - one[:, 1]
    owner[free], target[free] = one[:, 0], one[:, 2]
    used = max(int(base.max()), 0) + n_symbols + 1
    pad = max(0, used - len(owner))
    return base, np.append(owner, np.full(pad, -1, np.int32))[:used], np.append(target, np.zeros(pad, np.int32))[:used]


class CrossParser:
    """The automata of some languages; samples: language -> texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        joined = [self._joined(samples[k]) for k in self.languages]
        self.symbols = np.unique(np.concatenate([np.empty(0, np.uint32), *joined]))
        self._build(joined)
        self.usual = np.array([self._usual(samples[k]) for k in self.languages])

    def _build(self, joined: list[np.ndarray]) -> None:
        """One table for all languages; first: states after a phrase's first character, 0 if it is unknown."""
        parts, states, slots = [(np.zeros(1, np.int32), np.full(1, -1, np.int32), np.zeros(1, np.int32))], 1, 1
        self.first = np.zeros((len(joined), len(self.symbols) + 1), np.int32)
        for i, text in enumerate(joined):
            steps = suffix_automaton(self.coded(text))
            base, owner, target = displaced(steps, len(self.symbols) + 1)
            self.first[i, list(steps[1])] = np.array(list(steps[1].values()), np.int32) + states
            parts.append((base + slots, np.where(owner < 0, -1, owner + states), np.where(owner < 0, 0, target + states)))
            states, slots = states + len(base), slots + len(owner)
        self.base, self.owner, self.target = (np.concatenate(x).astype(np.int32) for x in zip(*parts, strict=True))

    @staticmethod
    def _joined(texts: list[str]) -> np.ndarray:
        return np.concatenate([np.append(letters(t), 32) for t in texts] or [np.empty(0, np.uint32)]).astype(np.uint32)

    @staticmethod
    def _usual(texts: list[str]) -> float:
        """Phrases per character of one half of a language's sample against the other; 0 if there is but one text."""
        if len(texts) < 2:
            return 0.0
        half = CrossParser.__new__(CrossParser)
        known, other = CrossParser._joined(texts[::2]), CrossParser._joined(texts[1::2])
        half.languages, half.symbols = ["half"], np.unique(known)
        half._build([known])
        return float(half.phrases([other])[0, 0] / len(other))

    def coded(self, text: np.ndarray) -> np.ndarray:
        """Symbols from 1 on; 0 for what no sample holds."""
        at = np.searchsorted(self.symbols, text)
        at[at == len(self.symbols)] = 0
        return np.where(self.symbols[at] == text, at + 1, 0).astype(np.int32) if len(self.symbols) else np.zeros(len(text), np.int32)

    def _step(self, state: np.ndarray, c: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a phrase begins with the characters c, states after them). State 0: the character before was a phrase's last."""
        at = self.base[state] + c
        new = (self.owner[at] != state) | (state == 0)
        return new, np.where(new, first, self.target[at])

    def _parse(self, parts: list[np.ndarray], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in each part, an array (languages, parts), and the states after it; entry: the states before it."""
        cuts = [(i, a) for i, t in enumerate(parts) for a in range(0, len(t), STRETCH)]
        cuts.sort(key=lambda x: -min(STRETCH, len(parts[x[0]]) - x[1]))
        where = {c: j for j, c in enumerate(cuts)}
        lengths = np.array([min(STRETCH, len(parts[i]) - a) for i, a in cuts], int)
        n_lang, n = len(self.languages), len(cuts)
        grid = np.zeros((STRETCH, n), np.int32)
        for j, (i, a) in enumerate(cuts):
            grid[: lengths[j], j] = parts[i][a : a + STRETCH]
        live = np.searchsorted(-lengths, -np.arange(STRETCH), side="left")  # stretches longer than the step
        before = np.array([where.get((i, a - STRETCH), -1) for i, a in cuts], int)
        state = np.zeros((n_lang, n), np.int32)
        firsts = np.flatnonzero(before < 0)
        state[:, firsts] = entry[:, [cuts[j][0] for j in firsts]]
        begins = np.zeros((STRETCH, n_lang, n), bool)
        for t in range(int(lengths[0]) if n else 0):
            k = live[t]
            begins[t, :, :k], state[:, :k] = self._step(state[:, :k], grid[t, :k], self.first[:, grid[t, :k]])
        total = begins.sum(axis=0, dtype=np.int64)
        # again from the true state before; a stretch whose predecessor's last state was not yet true is done once more
        todo = np.array(np.nonzero(np.broadcast_to(before >= 0, (n_lang, n)) & (state[:, np.maximum(before, 0)] != 0)))
        while todo.size:
            lang, lane = todo
            own = np.arange(len(lang))
            now, gain = state[lang, before[lane]], np.zeros(len(lang), np.int64)
            changed = np.zeros(len(lang), bool)
            for t in range(STRETCH):
                if not len(own):
                    break
                ended = lengths[lane[own]] <= t
                if ended.any():  # never met: the stretch's last state is another one
                    j = own[ended]
                    changed[j] = state[lang[j], lane[j]] != now[ended]
                    state[lang[j], lane[j]] = now[ended]
                    own, now = own[~ended], now[~ended]
                    if not len(own):
                        break
                x, y = lang[own], lane[own]
                new, now = self._step(now, grid[t, y], self.first[x, grid[t, y]])
                old = begins[t, x, y]
                gain[own] += new.astype(np.int64) - old
                begins[t, x, y] = new
                apart = ~(new & old)
                own, now = own[apart], now[apart]
            if len(own):
                changed[own] = state[lang[own], lane[own]] != now
                state[lang[own], lane[own]] = now
            np.add.at(total, (lang, lane), gain)
            after = np.array([where.get((i, a + STRETCH), -1) for i, a in (cuts[j] for j in lane[changed])], int)
            todo = np.array([lang[changed][after >= 0], after[after >= 0]])
        counts, last = np.zeros((n_lang, len(parts)), np.int64), entry.copy()
        np.add.at(counts.T, [c[0] for c in cuts], total.T)
        for i, t in enumerate(parts):
            if len(t):
                last[:, i] = state[:, where[(i, (len(t) - 1) // STRETCH * STRETCH)]]
        return counts, last

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases that each language needs for each text: an array (languages, texts)."""
        out = np.zeros((len(self.languages), len(texts)), np.int64)
        if not self.languages:
            return out
        held, size = [], 0
        fresh = lambda n: np.zeros((len(self.languages), n), np.int32)
        for i, t in enumerate([*texts, None]):
            if held and (t is None or size + len(t) > AT_ONCE):
                out[:, held] = self._parse([self.coded(texts[j]) for j in held], fresh(len(held)))[0]
                held, size = [], 0
            if t is not None and len(t) <= AT_ONCE:
                held.append(i)
                size += len(t)
            elif t is not None:  # a long text by itself, from state to state
                state = fresh(1)
                for a in range(0, len(t), AT_ONCE):
                    counts, state = self._parse([self.coded(t[a : a + AT_ONCE])], state)
                    out[:, i] += counts[:, 0]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float], list[float]]:
        """Language, score, phrases per character and excess of each text. The score is the part by which the runner-up needs more."""
        folded = [letters(t or "") for t in texts]
        some = [bool((t != 32).any()) for t in folded]
        need = self.phrases(folded)
        out = []
        for i in range(len(texts)):
            if not some[i] or not self.languages:
                out.append((UNDETERMINED, 0.0, 1.0, 1.0))
                continue
            own = need[:, i]
            best = int(np.argmin(own))
            other = np.delete(own, best).min() if len(own) > 1 else 2 * own[best]
            rate = min(1.0, own[best] / len(folded[i]))
            excess = (rate - self.usual[best]) / (1 - self.usual[best]) if self.usual[best] < 1 else 0.0
            out.append((self.languages[best], float(min(1.0, max(0.0, 1 - own[best] / other))), float(rate), float(max(0.0, excess))))
        return tuple(list(x) for x in zip(*out, strict=True)) if out else ([], [], [], [])


def sample(docs: DataFrame, text: str, label: str) -> dict[str, list[str]]:
    """For each label, whole texts: all that the classifier learns from.

    Of a label's texts those that come first by a hash of the text, TRAIN_DOCS at most and no more than TRAIN_CHARS characters together (one
    text at least). Texts of more than a 16th of that are taken only where shorter ones are lacking, those of more than TRAIN_LONGEST
    never. Rows without text or label are left out. The limit per label holds in every task before rows move; the driver gets, for each label,
    TRAIN_DOCS texts of up to TRAIN_CHARS characters, or one of up to TRAIN_LONGEST.
    """
    size = F.length(text)
    rows = docs.where(F.col(text).isNotNull() & F.col(label).isNotNull() & (F.length(F.trim(text)) > 0) & (size <= TRAIN_LONGEST))
    rows = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), F.greatest(size, F.lit(TRAIN_CHARS // 16)).alias("size"), F.xxhash64(text).alias("place"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("size", "place", "text"))
    # a text above TRAIN_CHARS counts only where a label has none before it
    usable = (F.col("n") == 1) | (F.length("text") <= TRAIN_CHARS)
    found = rows.withColumn("n", place).where((F.col("n") <= TRAIN_DOCS) & usable).select("label", "n", "text").collect()
    by: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r.label, r.n)):
        texts = by.setdefault(r.label, [])
        if not texts or sum(map(len, texts)) + len(r.text) <= TRAIN_CHARS:
            texts.append(r.text)
    return by


def identify(docs: DataFrame, text: str, samples: dict[str, list[str]]) -> DataFrame:
    """Add lang_pred, score (0 to 1), phrase_rate (0 to 1) and excess (0 to 1) to docs, in place; the whole text is parsed.

    A null text, one without a letter, or any text if nothing was learned is `und` with score 0. Ties
    go to the language first in order. Columns of these names that docs has are replaced; repeated
    rows are each predicted; an empty table stays empty. The automata, of bounded size, are built once and sent along.
    """
    python_batches(docs.sparkSession)
    rows = docs.drop("lang_pred", "score", "phrase_rate", "excess")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields)
    at, parser = rows.columns.index(text), CrossParser(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = parser.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[0], pa.string()), *[pa.array(x, pa.float64()) for x in found[1:]]], [*batch.schema.names, "lang_pred", "score", "phrase_rate", "excess"])

    return rows.mapInArrow(run, f"{kinds}lang_pred string, score double, phrase_rate double, excess double")


def held_out(doc_id: str) -> F.Column:
    """Whether a document is never learned from: the checksum of its id as text leaves remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame) -> dict[str, list[str]]:
    """The sample of a table with doc_id, text and lang, without held-out documents."""
    return sample(docs.where(~held_out("doc_id")), "text", "lang")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), "text", learn(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "phrase_rate", "excess")
