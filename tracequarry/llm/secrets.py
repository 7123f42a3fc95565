"""Secret scan: fixed patterns, and Markov models of random and ordinary strings.

The models are first-order character chains with a start state. One is trained on
random strings, the other on identifiers and words; a candidate is reported if the
log-likelihood ratio per character exceeds a threshold fitted on the labelled samples.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so the length can be part of the pattern
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")  # runs are maximal
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

# fixed values: words from which ordinary identifiers are made
WORDS = """
account action address array background base batch block body border bottom buffer build button cache call cell
channel char check child class clear client clock close code color column command common config connect container
content context control copy core count create cursor data date debug default delete depth detail device dialog
direct display document domain down draw drive edge edit element email enable end engine entry error event execute
export factory field file filter first flag flow focus folder font format frame function gateway global graph group
handler hash header height hidden history host icon image import index info input insert instance interface item
kernel label layer layout left length level limit line link list load local lock login manager mapping master match
menu message meta method model module mouse name network node number object offset option order output owner page
panel parent parse path pattern payment pixel point policy position price process profile project property provider
""".split()
# fixed values: pieces of long words in prose
PROSE = """
ability able according action al ally ance and ation ative ed ence ential er est ever ful graph hand heit her hood hyper ible ically inter ing
ion ish ism istic ity ive ization less like logical ly ment mis ness non ology one other ous over per phone port pre pro re scope self ship some
sion some sub super tele ter that the thing tion trans tric un under ure ward ways where wise with work world
ab an arbeit auf aus auch bau be ber berg bund chen der die dies ein einander end ent er erst fahrt frei gegen gehen gemein gesell ge haupt haus
heim herr hoch ich isch jahr kampf keit kraft land lang leben lich machen mit nach nicht ober ordnung recht reich richt sam schaft schiff schrift
schlag schul schutz selbst sich stadt stand stell trag um und ung unter ver vor wasser wechsel weg werk wirt wissen wort zeit zu zug zwischen
aient aise anti aux avec ce comme con dans de des elle ement ence ent entre est eur euse eux ible ifier ique isation issement iste lement les leur
mais ment nous par pas plus pour que quelle qui rait re sans ser sont sous sur te tion toire tout une vous
ado ando ante ar arse cia ciones como con contra cuando de dad dades del desde el ella en encia ente entre era es esta hasta iendo idad illo ismo
izar la las lo los mente miento mos muy no nos nte oso para pero por que quien res ser si sin sobre su tiva todo una ver y
""".split()


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio, random against ordinary, of each pair of characters; and the threshold."""

    ratio: dict[str, float]
    threshold: float

    def score(self, text: str) -> float:
        pairs = zip(f"^{text}", text)
        return sum(self.ratio.get(a + b, 0.0) for a, b in pairs) / len(text)

    def is_random(self, text: str) -> bool:
        return self.score(text) > self.threshold


def labelled_samples(n: int = 2000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled strings: 1 for random ones, 0 for identifiers, paths, numbered names, long words and pieces of the alphabet."""
    rng = random.Random(seed)
    alphabets = (ALPHABET[:62], ALPHABET[:64], "0123456789abcdef", ALPHABET[:26] + "0123456789", ALPHABET[26:62])
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))), 1) for _ in range(n)]
    for _ in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(3, 7))]
        style = rng.randrange(8)
        if style == 0:
            name = words[0] + "".join(w.title() for w in words[1:])
        elif style == 1:
            name = "_".join(words)
        elif style == 2:
            name = "-".join(words)
        elif style == 3:
            name = "/".join(words)
        elif style == 4:
            name = "_".join(words).upper()
        elif style == 5:
            at, row = rng.randrange(10), rng.choice((ALPHABET[:26], ALPHABET[26:52]))
            out.append((row[at : at + rng.randint(16, 26)], 0))
            continue
        else:
            name = "".join(rng.choices(PROSE, k=rng.randint(4, 9)))
            out.append((name.capitalize() if rng.random() < 0.2 else name, 0))
            continue
        out.append((name + rng.choice(("", "", str(rng.randint(0, 9)), f"_{rng.randint(0, 2030)}", f"-v{rng.randint(1, 20)}")), 0))
    return out


def train(samples: Iterable[tuple[str, int]], smoothing: float = 0.5) -> Markov:
    """Fit both chains; the threshold is where the samples' two score distributions are told apart best."""
    samples = [(s, y) for s, y in samples if s]
    counts: list[dict[str, dict[str, float]]] = [{}, {}]
    for text, label in samples:
        for a, b in zip(f"^{text}", text):
            row = counts[label].setdefault(a, {})
            row[b] = row.get(b, 0.0) + 1.0
    ratio = {}
    for a in f"^{ALPHABET}":
        rows = [c.get(a, {}) for c in counts]
        totals = [sum(r.values()) + smoothing * len(ALPHABET) for r in rows]
        for b in ALPHABET:
            p = [(r.get(b, 0.0) + smoothing) / t for r, t in zip(rows, totals)]
            ratio[a + b] = math.log(p[1] / p[0])
    scored = sorted((Markov(ratio, 0.0).score(s), y) for s, y in samples)
    wrong = best = sum(1 for _, y in scored if y == 0)
    cut = scored[0][0] - 1.0 if scored else 0.0
    for (score, label), after in zip(scored, [*scored[1:], (math.inf, 1)]):
        wrong += 1 if label else -1
        if wrong < best:
            best, cut = wrong, (score + min(after[0], score + 1.0)) / 2
    return Markov(ratio, cut)


def scan(text: str, model: Markov) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in ``text``, by start, then kind in the order of ``KINDS``.

    The pattern kinds may overlap each other; a span of the models is added only where
    no pattern has found anything. The models see whole runs of at least 16 characters
    of keys with a letter among them; a full stop parts runs.
    """
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    base = sorted(spans)
    for m in CANDIDATE.finditer(text):
        found = m.group()
        if any(c.isalpha() for c in found) and not any(s < m.end() and e > m.start() for s, e, _ in base) and model.is_random(found):
            spans.append((m.start(), m.end(), "markov"))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def digest_spans(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Markov | None = None) -> DataFrame:
    """One row per document: ``key`` and ``secrets``, an array of (start, end, kind, value, ratio).

    Offsets are code points, the end exclusive; ``ratio`` is the models' log-likelihood
    ratio per character, null for patterns. Null and empty texts have no secrets; whole
    texts are scanned, however long. Spans that start at one place are in the order of
    ``KINDS``. Repeated rows give repeated results, an empty table none; other columns
    aren't looked at, whatever their names.
    """
    model = model or train(labelled_samples())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for t in batch["text"]:
                t = t if isinstance(t, str) else ""
                found.append([(s, e, k, t[s:e], model.score(t[s:e]) if k == "markov" else None) for s, e, k in scan(t, model)])
            yield pd.DataFrame({"id": batch["id"], "secrets": found})

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {kind}, secrets array<struct<start: bigint, end: bigint, kind: string, value: string, ratio: double>>"
    return rows.mapInPandas(run, schema).withColumnRenamed("id", key)


def secret_digests(docs: DataFrame) -> DataFrame:
    """``scan_secrets`` as counts and digests, one row per document."""
    found = scan_secrets(docs)
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.filter("secrets", lambda s: s["kind"] != "markov")), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )


def sha256_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(digest_spans([s for s in spans if s[2] != "markov"]).encode()).hexdigest()
