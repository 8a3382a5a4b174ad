"""Language identification with interpolated Kneser-Ney character models."""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import stage
from .frames import HASHES, batch_of, hash_bounds
from .hashing import U64, mix, randoms, signed, slices

UNKNOWN = "und"
_BLANK, _PAD = 32, 0
_BLOCK = 200_000  # characters scored at once


@cache
def _alphabet() -> np.ndarray:
    """The lower-case letter of each code point, a blank for those that are no letters."""
    out = np.full(0x110000, _BLANK, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            small = chr(c).lower()
            out[c] = ord(small) if len(small) == 1 else c
    return out


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as lower-case letters, each run of other characters as one blank.

    Returns the characters, the n + 1 offsets of the texts, and which texts have a letter.
    """
    texts = [t or "" for t in texts]
    ends = np.cumsum([0, *map(len, texts)])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _alphabet()[codes]
    blank = codes == _BLANK
    kept = ~blank
    kept[1:] |= kept[:-1] & blank[1:]  # the first of a run of blanks stands for the run
    starts = ends[:-1][np.diff(ends) > 0]
    kept[starts] = True
    before = np.concatenate([[0], np.cumsum(kept)])
    letters = np.concatenate([[0], np.cumsum(~blank)])[ends]
    return codes[kept], before[ends], np.diff(letters) > 0


class Grams:
    """Hashes of the n characters that end at each character of some texts, n = 0..order."""

    def __init__(self, chars: np.ndarray, offs: np.ndarray, order: int):
        self.owner = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
        flat = np.full(len(chars) + order * len(offs), _PAD, np.uint32)
        self.spots = np.arange(len(chars)) + (self.owner + 1) * order
        flat[self.spots] = chars
        letters = mix(flat.astype(U64) + U64(1))
        self.sums = [np.zeros(len(flat), U64)]
        for n, factor in enumerate(randoms(order, 77) | U64(1)):
            shifted = np.zeros(len(flat), U64)
            shifted[n:] = letters[:len(flat) - n] * factor
            self.sums.append(self.sums[-1] + shifted)

    def at(self, n: int, which: np.ndarray | slice = slice(None), back: int = 0) -> np.ndarray:
        """Of the chosen characters; with back = 1, the n characters before them."""
        return mix(self.sums[n][self.spots[which] - back] + U64(n))


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


@dataclass
class LanguageModels:
    """Models of all languages over common sorted hash arrays.

    ``hashes[n]`` holds the hashes of the n-grams seen in any language, sorted, ``log_p[n]``
    their interpolated log probabilities, a column per language, and ``log_back[n]`` the log
    weight that each, as a context, leaves to shorter n-grams.
    """

    languages: list[str]
    order: int
    hashes: list[np.ndarray]
    log_p: list[np.ndarray]
    log_back: list[np.ndarray]
    log_floor: np.ndarray
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    slack: float = 0.0
    reject_z: float = 0.0

    def _log_p(self, grams: Grams) -> np.ndarray:
        count = len(grams.spots)
        out = np.zeros((count, len(self.languages)), np.float32)
        left = np.arange(count)
        for n in range(self.order, 0, -1):
            at, hit = _find(self.hashes[n], grams.at(n, left))
            out[left[hit]] += self.log_p[n][at[hit]]
            left = left[~hit]
            if not len(left):
                return out
            at, hit = _find(self.hashes[n - 1], grams.at(n - 1, left, 1))
            out[left[hit]] += self.log_back[n - 1][at[hit]]
        out[left] += self.log_floor
        return out

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nats per character (a row per text, a column per language), lengths, has a letter."""
        chars, offs, lettered = characters(texts)
        sums = np.zeros((len(texts), len(self.languages)))
        at = 0
        while at < len(chars):  # texts are cut at block ends; each block sees the characters before it
            end = min(len(chars), at + _BLOCK)
            first = int(np.searchsorted(offs, at, "right")) - 1
            lead = min(self.order, at - int(offs[first]))
            last = int(np.searchsorted(offs, end))
            inner = np.concatenate([[0], np.clip(offs[first + 1:last], at, end) - at + lead, [end - at + lead]])
            grams = Grams(chars[at - lead:end], inner, self.order)
            grams.spots, grams.owner = grams.spots[lead:], grams.owner[lead:]
            log_p = self._log_p(grams)
            for column in range(len(self.languages)):
                sums[first:last, column] += np.bincount(grams.owner, weights=log_p[:, column], minlength=last - first)
            at = end
        lengths = np.diff(offs)
        return -sums / np.maximum(lengths, 1)[:, None], lengths, lettered

    def posterior(self, entropy: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        logit = -self.temperature * np.sqrt(lengths)[:, None] * entropy
        odds = np.exp(logit - logit.max(1, keepdims=True))
        return odds / odds.sum(1, keepdims=True)


def _kneser_ney(grams: pd.DataFrame, languages: list[str], order: int, discount: float) -> LanguageModels:
    """Models from the distinct n-grams of highest order with their counts.

    Columns: language (a number), n, and for each order the hash g<n> of the last n characters and c<n> of the n
    characters before the last one (c0 and g0 stand for no characters).
    """
    many = len(languages)
    hashes, log_p, log_back = [np.array([mix(np.zeros(1, U64))[0]])], [np.zeros((1, many))], []
    p_tables = [None]
    for n in range(1, order + 1):
        if n == order:
            counts = grams.groupby(["language", f"g{n}", f"c{n - 1}", f"g{n - 1}"], as_index=False)["n"].sum()
        else:  # a lower order counts the different characters before the n-gram
            counts = grams.drop_duplicates(["language", f"g{n + 1}"]).groupby(
                ["language", f"g{n}", f"c{n - 1}", f"g{n - 1}"], as_index=False).size().rename(columns={"size": "n"})
        known = np.unique(counts[f"g{n}"].to_numpy(U64))
        context = counts.groupby(["language", f"c{n - 1}"])["n"].agg(["sum", "size"]).reset_index()
        contexts = np.unique(context[f"c{n - 1}"].to_numpy(U64))
        where = np.searchsorted(contexts, context[f"c{n - 1}"].to_numpy(U64)), context["language"].to_numpy()
        weight, total = np.ones((len(contexts), many)), np.ones((len(contexts), many))
        weight[where], total[where] = discount * context["size"] / context["sum"], context["sum"]
        back_here = np.ones((len(hashes[n - 1]), many))
        at, hit = _find(hashes[n - 1], contexts)
        back_here[at[hit]] = weight[hit]
        log_back.append(np.log(back_here).astype(np.float32))
        # every known n-gram gets the lower probability of its tail, in every language
        tails = counts.drop_duplicates(f"g{n}").sort_values(f"g{n}")
        if n == 1:
            lower = np.full((len(known), many), 1.0 / (len(known) + 1))
            floor = lower[:1]
        else:
            lower = p_tables[n - 1][np.searchsorted(hashes[n - 1], tails[f"g{n - 1}"].to_numpy(U64))]
        ctx = np.searchsorted(contexts, tails[f"c{n - 1}"].to_numpy(U64))
        back, base = weight[ctx], total[ctx]
        seen = np.zeros((len(known), many))
        seen[np.searchsorted(known, counts[f"g{n}"].to_numpy(U64)), counts["language"].to_numpy()] = np.maximum(counts["n"] - discount, 0)
        p = seen / base + back * lower
        hashes.append(known)
        p_tables.append(p)
        log_p.append(np.log(p).astype(np.float32))
    return LanguageModels(languages, order, hashes, log_p, log_back, np.log(floor[0]).astype(np.float32))


def fit(labelled: DataFrame, order: int = 4, discount: float = 0.75, fit_chars: int = 2_000_000, reject_z: float = 6.0, slack: float = 0.6) -> LanguageModels:
    """Models of every language in ``labelled(lang, text)``.

    ``fit_chars`` bounds what is learned from: of each language, different texts in the order of a
    content hash until so many characters are reached (all of a smaller table; no more than twice
    as many, or one text).  Each fifth of these texts is kept from the models and calibrates them:
    the temperature of the score (least log loss) and each language's usual cross-entropy,
    robustly, for the rejection; a language with fewer texts rejects none.

    Rows without a language or text are not used.  No usable row gives models of no language.
    """
    rows = labelled.where("lang IS NOT NULL AND length(text) > 0").select("lang", "text", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(HASHES)).alias("at"))
    keys = stage(rows.groupBy("lang", "at").agg(F.max(F.length("text")).alias("n")))
    bounds = hash_bounds(keys, "lang", fit_chars)
    languages = sorted(bounds)
    if not languages:
        return LanguageModels([], order, [], [], [], np.zeros(0))
    place = F.create_map(*[F.lit(x) for name in languages for x in (name, bounds[name])])
    number = F.create_map(*[F.lit(x) for i, name in enumerate(languages) for x in (name, i)])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    sample = rows.where(F.col("at") < place[F.col("lang")]).dropDuplicates(["lang", "at"]).select(
        number[F.col("lang")].alias("language"), "text", (turn % 5 == 0).alias("held"))
    sample = stage(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            chars, offs, _ = characters(part.column("text").to_pylist())
            grams = Grams(chars, offs, order)
            owner = np.asarray(part.column("language"))[grams.owner]
            # the longest n-gram tells all its tails: the other columns are made once for each
            _, at, n = np.unique(mix(grams.at(order) ^ mix(owner.astype(U64) + U64(1))), return_index=True, return_counts=True)
            columns = {"language": owner[at]} | {f"g{k}": signed(grams.at(k, at)) for k in range(order + 1)} | {f"c{k}": signed(grams.at(k, at, 1)) for k in range(order)}
            yield batch_of(columns | {"n": n})

    keys = ["language", *[f"g{n}" for n in range(order + 1)], *[f"c{n}" for n in range(order)]]
    schema = "language int, " + ", ".join(f"{k} long" for k in keys[1:]) + ", n long"
    grams = sample.where("NOT held").mapInArrow(count, schema).groupBy(*keys).agg(F.sum("n").alias("n")).toPandas()
    if grams.empty:
        return LanguageModels([], order, [], [], [], np.zeros(0))
    for k in keys[1:]:
        grams[k] = grams[k].to_numpy(np.int64).view(U64)
    models = _kneser_ney(grams, languages, order, discount)
    models.slack, models.reject_z = slack, reject_z

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            entropy, lengths, lettered = models.cross_entropy(part.column("text").to_pylist())
            yield batch_of({
                "language": part.column("language"), "length": np.where(lettered, lengths, 0),
                "entropy": pa.array(list(entropy), pa.list_(pa.float64())),
            })

    held = sample.where("held").mapInArrow(measure, "language int, length long, entropy array<double>").where("length > 0").toPandas()
    _calibrate(models, held)
    return models


def _calibrate(models: LanguageModels, held: pd.DataFrame) -> None:
    many = len(models.languages)
    models.mean, models.spread = np.full(many, np.inf), np.zeros(many)
    if held.empty:
        return
    entropy, length, truth = np.stack(held["entropy"]), held["length"].to_numpy(), held["language"].to_numpy()
    losses = []
    grid = 2.0 ** np.arange(-4, 7)
    for models.temperature in grid:
        p = models.posterior(entropy, length)[np.arange(len(truth)), truth]
        losses.append(-np.log(np.maximum(p, 1e-12)).mean())
    models.temperature = float(grid[int(np.argmin(losses))])
    own = entropy[np.arange(len(truth)), truth]
    for i in range(many):
        mine = own[truth == i]
        if len(mine):
            models.mean[i] = np.median(mine)
            models.spread[i] = 1.4826 * np.median(np.abs(mine - models.mean[i]) * np.sqrt(length[truth == i]))


def _runs(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of the list with at most so many characters each, or one text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t or "") > most:
            yield at, i
            at, size = i, 0
        size += len(t or "")
    if at < len(texts):
        yield at, len(texts)


def identify(models: LanguageModels, text: Column) -> Column:
    """struct(lang, score, cross_entropy, rejected) of a text column.

    ``lang`` has the least cross-entropy per character; ``score`` (0 to 1) is its calibrated
    share against the other languages.  ``rejected``: no letter, or more nats per character than
    the language's usual value plus ``slack`` plus ``reject_z`` standard errors at that length.
    A text that is null or has no letter is ``und`` with score 0.
    """
    def judge(texts: list[str | None]) -> pd.DataFrame:
        entropy, lengths, lettered = models.cross_entropy(texts)
        best = entropy.argmin(1)
        least = entropy[np.arange(len(best)), best]
        limit = models.mean[best] + models.slack + models.reject_z * models.spread[best] / np.sqrt(np.maximum(lengths, 1))
        score = models.posterior(entropy, lengths).max(1)
        return pd.DataFrame({
            "lang": np.where(lettered, np.array(models.languages, object)[best], UNKNOWN), "score": np.where(lettered, score, 0.0),
            "cross_entropy": least, "rejected": ~lettered | (least > limit),
        })

    @F.pandas_udf("lang string, score double, cross_entropy double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.tolist()
            texts = [t if isinstance(t, str) else None for t in texts]
            if not models.languages:
                lettered = [any(map(str.isalpha, t or "")) for t in texts]  # nothing learned: nothing else to reject by
                yield pd.DataFrame({"lang": UNKNOWN, "score": 0.0, "cross_entropy": 0.0, "rejected": [not x for x in lettered]}, index=range(len(texts)))
                continue
            parts = []
            for at, end in _runs(texts, 1_000_000):
                parts.append(judge(texts[at:end]))
            yield pd.concat(parts, ignore_index=True) if parts else judge([])

    return predict(text)


def learned_from(docs: DataFrame) -> DataFrame:
    """(lang, text) of the rows that may be learned from; the others are held out."""
    return docs.where(~held_out()).select("lang", "text")


def held_out() -> Column:
    """Whether crc32 of the id, as text, leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_known(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """The rows whose text is not rejected, with all their columns."""
    return docs.where(~identify(models, docs["text"])["rejected"])
