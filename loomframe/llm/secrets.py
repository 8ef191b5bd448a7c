"""Secret scan: fixed patterns and character Markov models.

Two first-order character models are trained from labelled samples, one of random strings (keys of
several alphabets, of one case as of both) and one of ordinary identifiers (words, camel and snake
case, paths, numbers). Runs of ``LEAST`` key characters or more are candidates; what the fixed
patterns have matched is cut out of them, and the rest of a run is judged like a run. A candidate is
a secret when the log-likelihood ratio of the two models, summed over its characters, is above a
threshold that is set from held-out ordinary samples. Numbers are ordinary, however random.

Offsets are code points, ends exclusive. Defined cases: a null text is empty and holds nothing; spans
that begin together stand in the order of KINDS; repeated rows each give a row; very long texts and
runs take time in proportion to their length; further columns are ignored, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# runs below 24 characters fail in any case
HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of a candidate at least.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")

WORDS = (
    "account action active address admin after alert amount array async audio author back base batch before binary block board body buffer build button byte cache call camera "
    "cancel cart chain change channel check child class clean click client close cloud code color column command comment commit common config connect content context control copy "
    "count create current customer data date debug default delete detail device dialog document domain download draft driver edit element email enable engine error event example "
    "export extra factory field file filter final find first float folder font form format frame from function gateway general get global graph group handle handler header height "
    "hidden history home host icon image import index info init input insert install internal invoice item iterator join json key label language last layer layout length level "
    "library light limit line link list listener load local location lock login loop machine main manager map master match matrix max memory menu message meta method metric min "
    "mode model module monitor mouse move name native network next node note number object offset online open option order output package page panel parent parse part patch path "
    "payment pending person phone pixel player point policy pool position post prepare preview price primary print private process product profile project property protocol "
    "provider proxy public push query queue random range rate read record refresh region register release remote remove render replace report request reset resource response "
    "result return role route row rule runtime sample save scale scan schedule schema scope score screen script search second section select send server service session set shape "
    "share signal simple size slot socket sort source space spec stack start state static status step stop storage store stream string style submit summary switch symbol sync system "
    "table target task template temp test text theme thread time title toggle tool topic total trace track train transfer tree trigger type unit update upload user util value "
    "vector verify version video view visible volume watch weight widget width window worker write zone"
).split()
#: Frequent groups of letters of English, German, French and Spanish words.
SYLLABLES = (
    "able an ance and be ble con de ea ed el en ence er es ful ing ion ist la ly ment ness nd ni on oo or ou ough ous ra re ri se sh ship st te th the ther ti tion to tra ver ward wh "
    "ander auf aus bei cht ei ein eit els ern eu heit ich icht ie keit lich lung pf qu rt sch tz ung vor zu nach au "
    "ai ais ait ans aux ch des du eau elle ette eur eux ez ier ieux ill ir le les oi oir ont our ouv pa pas que qui tre un ur vi "
    "ado ancia ar as cion dad ente ero est iendo ido lla las los mento os para por ro rra ue"
).split()
BASE62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


#: Alphabets of keys.
ALPHABETS = {
    "base62": BASE62,
    "base64": BASE62 + "+/",
    "url": BASE62 + "-_",
    "hex": "0123456789abcdef",
    "upper and digits": BASE62[:26] + BASE62[52:],
    "lower and digits": BASE62[26:],
    "letters": BASE62[:52],
    "upper": BASE62[:26],
    "lower": BASE62[26:52],
}


def random_sample(r: random.Random) -> str:
    return "".join(r.choices(ALPHABETS[r.choice(list(ALPHABETS))], k=r.randint(LEAST, 60)))


def ordinary_sample(r: random.Random) -> str:
    kind = r.random()
    if kind < 0.35:
        parts = ["".join(r.choices(SYLLABLES, k=r.randint(2, 6))) for _ in range(r.randint(1, 3))]
    else:
        parts = r.choices(WORDS, k=r.randint(2, 6))
    if r.random() < 0.25:
        parts.insert(r.randrange(len(parts) + 1), str(r.randint(0, 10 ** r.randint(1, 8))))
    style = r.choice(["_", "-", "/", "", "camel", "upper", "title", "="])
    if style == "camel":
        s = parts[0] + "".join(p.capitalize() for p in parts[1:])
    elif style == "upper":
        s = r.choice(["_", "", "-"]).join(parts).upper()
    elif style == "title":
        s = "".join(p.capitalize() for p in parts)
    else:
        s = style.join(parts)
    if r.random() < 0.05:
        s = r.choice("-=_+/0") * r.randint(20, 40)
    if r.random() < 0.08:
        s = "".join(r.choices("0123456789", k=r.randint(20, 30)))
    if r.random() < 0.05:
        s = f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}_" + s
    return s


class Markov:
    """Log-likelihood ratio of characters following each other, random over ordinary."""

    def __init__(self, positive: list[str], negative: list[str], smooth: float = 0.5):
        self.ratio = self._table(positive, smooth) - self._table(negative, smooth)

    @staticmethod
    def _table(samples: list[str], smooth: float) -> np.ndarray:
        counts = np.full((128, 128), smooth / 16)
        used = [ord(c) for c in BASE62 + "+/_=-"]
        counts[np.ix_(used, used)] = smooth
        for s in samples:
            x = np.frombuffer(s.encode(), np.uint8)
            np.add.at(counts, (x[:-1], x[1:]), 1)
        return np.log(counts / counts.sum(1, keepdims=True))

    def score(self, s: str) -> float:
        x = np.frombuffer(s.encode(), np.uint8)
        return float(self.ratio[x[:-1], x[1:]].sum())


@cache
def default_model(samples: int = 20_000, seed: int = 11) -> tuple[Markov, float]:
    """The models and the threshold: random likelier than ordinary, and no held-out ordinary sample in 1,000 passes it."""
    r = random.Random(seed)
    model = Markov([random_sample(r) for _ in range(samples)], [ordinary_sample(r) for _ in range(samples)])
    held = [s for s in (ordinary_sample(r) for _ in range(samples)) if len(s) >= LEAST]
    return model, max(0.0, float(np.quantile([model.score(s) for s in held], 0.999)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns' matches."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def markov_spans(text: str, base: list[tuple[int, int, int]], model: Markov, threshold: float) -> list[tuple[int, int, int]]:
    """Runs of key characters that look random, without what base spans cover of them."""
    out = []
    covered: list[list[int]] = []  # base spans, united
    for x, _, y in base:
        if covered and x <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], y)
        else:
            covered.append([x, y])
    k = 0
    for m in CANDIDATE.finditer(text):
        a, end = m.span()
        while k < len(covered) and covered[k][1] <= a:
            k += 1
        j = k
        while a < end:
            cut = min(covered[j][0], end) if j < len(covered) else end
            if cut - a >= LEAST and model.score(text[a:cut]) > threshold:
                out.append((a, 3, cut))
            a = covered[j][1] if j < len(covered) and cut < end else end
            j += 1
    return out


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, counts of each kind, ``base_sha256`` and ``spans`` of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(default_model())

    @F.pandas_udf("n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")
    def found(text: pd.Series) -> pd.DataFrame:
        model, threshold = sent.value
        rows = []
        for t in text:
            t = t or ""
            base = base_spans(t)
            more = markov_spans(t, base, model, threshold)
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in range(3)), len(more), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(base + more)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    return docs.select(F.col(id_col).alias("id"), found(F.col(text_col).cast("string")).alias("f")).select("id", "f.*")
