"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two order-1 models with add-half smoothing are trained from labelled samples, one of random strings and one of identifiers.
A candidate, a run of 20 or more of ``[A-Za-z0-9+/_=-]`` that holds letters and digits and overlaps no pattern's span, is a
secret where the log-likelihood ratio for each character is above a threshold. The pattern spans always stay.

Edge cases: null and empty texts have no spans; spans count code points; matches of a kind never overlap; ties at one start
stand in the order assign, access, hex, markov; a very long text is read whole; repeated rows get equal spans; an empty table gives
none; extra columns stay, but those named like an added one are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, small_batches, table

# The base patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched whole, so this is [0-9a-f]+ of 32 or more
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
THRESHOLD = 0.6

# Parts of identifiers, joined by rule to make the ordinary samples.
PARTS = (
    "user account index value total count http server client request response handler parser token stream buffer file path name "
    "list array string number date time zone local remote cache table column row query result error warning message event "
    "order item price stock market data model train test batch size config option default version build release module package "
    "class method function object field type node edge graph tree leaf root parent child first last next previous start end "
    "open close read write update delete insert create remove find search sort merge split join left right upper lower word "
    "line page document image video audio codec frame sample rate channel window layer weight bias learning step epoch loss"
).split()
# Names with digits in them that identifiers often have.
TECHNICAL = "utf8 utf16 ipv4 ipv6 int8 int32 int64 uint8 float32 float64 fp16 fp32 sha1 sha256 md5 crc32 http2 base64 x86 x64 amd64 arm64 win32 python3 iso8859 latin1 rfc822 rfc2047 v1 v2 v3 p256 h264 mp3 mp4 s3 ec2 k8s l2 t5 2d 3d".split()


def samples(seed: int = 7, n: int = 4000) -> tuple[list[str], list[str]]:
    """Labelled samples: random strings over the usual alphabets, and identifiers of PARTS in the usual styles."""
    rng = np.random.default_rng(seed)
    alphabets = ("0123456789abcdef", ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], ALPHABET[:62] + "_-")
    secret = ["".join(np.array(list(a))[rng.integers(0, len(a), int(rng.integers(20, 60)))]) for a in (alphabets[i % 6] for i in range(n))]
    plain = []
    for i in range(n):
        words = [PARTS[j] for j in rng.integers(0, len(PARTS), int(rng.integers(3, 7)))]
        if i % 3:
            words.insert(int(rng.integers(0, len(words) + 1)), TECHNICAL[int(rng.integers(0, len(TECHNICAL)))])
        number = str(rng.integers(0, 10 ** int(rng.integers(1, 5))))
        year = f"{rng.integers(1990, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
        big = [w.capitalize() for w in words]
        styles = (
            "_".join(words) + "_" + number, "-".join(words) + "-" + year, words[0] + "".join(big[1:]) + number, "/".join(words) + "/" + number, "_".join(words).upper() + number, "=" * int(rng.integers(20, 40)),
            "test" + "".join(big) + number, "/".join(words[:2]).upper() + "/" + "-".join(big[2:]), "_" + "_".join(words) + "_",
        )
        plain.append(styles[i % len(styles)])
    return secret, plain


def fit(texts: Iterable[str]) -> np.ndarray:
    """log P(next character | character) with add-half smoothing; row 0 is the start, column 0 any other character."""
    index = {c: i + 1 for i, c in enumerate(ALPHABET)}
    counts = np.full((len(ALPHABET) + 1,) * 2, 0.5)
    for t in texts:
        before = 0
        for c in t:
            now = index.get(c, 0)
            counts[before, now] += 1
            before = now
    return np.log(counts / counts.sum(1, keepdims=True))


def train(secret: Iterable[str], plain: Iterable[str]) -> np.ndarray:
    """The table of log-likelihood ratios, positive where random strings are likelier."""
    return fit(secret) - fit(plain)


class Scanner:
    """Finds the spans of a text; built once for each task from the table of ratios."""

    def __init__(self, ratios: np.ndarray, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.index = {c: i + 1 for i, c in enumerate(ALPHABET)}
        self.ratios = ratios.tolist()

    def ratio(self, text: str) -> float:
        """Mean log-likelihood ratio of the characters; 0 for an empty text."""
        before, total = 0, 0.0
        for c in text:
            now = self.index.get(c, 0)
            total += self.ratios[before][now]
            before = now
        return total / max(1, len(text))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's place, end), in the order of the contract."""
        found: list[tuple[int, int, int]] = []
        low = text.lower()
        if any(w in low for w in WORDS):  # few texts have one, and the search for words is the faster one
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        found.sort()
        base, at, reach = len(found), 0, 0  # candidates come from left to right, so one walk along the sorted spans tells what they overlap
        for m in CANDIDATE.finditer(text):
            s, e = m.span()
            while at < base and found[at][0] < e:
                reach = max(reach, found[at][2])
                at += 1
            part = m[0]
            if reach <= s and any(c.isdigit() for c in part) and any(c.isalpha() for c in part) and self.ratio(part) > self.threshold:
                found.append((s, 3, e))
        return sorted(found)


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(df: DataFrame, text: str = "text", ratios: np.ndarray | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds n_assign, n_access, n_hex, base_sha256 and spans and leaves the text out; columns of these names are replaced."""
    added = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    narrow = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in added])
    at, names = narrow.columns.index(text), narrow.columns
    schema = narrow.drop(text).selectExpr("*", "0L n_assign", "0L n_access", "0L n_hex", "'' base_sha256", "'' spans").schema
    ratios = train(*samples()) if ratios is None else ratios

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(ratios, threshold)
        for b in batches:
            rows = []
            for t in b.column(at).to_pylist():
                spans = scanner.spans(t or "")
                base = joined(x for x in spans if x[1] < 3)
                rows.append((*(sum(x[1] == k for x in spans) for k in range(3)), hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
            new = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names)) if i != at] + [pa.array(v, k) for v, k in zip(new, kinds, strict=True)], schema.names)

    return mapped(narrow, run, schema)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
