"""Secret scans: pattern candidates, and a random forest that removes false positives; DataFrame functions only on the scan."""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Prefixes of public key formats.
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ", "npm_"]

# Frequent letter pairs, and words that occur inside harmless identifiers.
PAIRS = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "as", "ou", "io", "le"]
DICTIONARY = ["account", "address", "alpha", "android", "article", "asset", "beta", "build", "cache", "chapter", "class", "client", "config", "content", "data", "date", "default", "demo", "document", "example", "file", "final", "font", "image", "index", "item", "label", "layout", "linux", "list", "local", "main", "master", "member", "model", "name", "node", "number", "object", "option", "order", "page", "photo", "placeholder", "product", "profile", "project", "release", "report", "sample", "section", "server", "session", "size", "style", "table", "target", "test", "thumb", "title", "type", "update", "user", "value", "version", "video", "window", "your"]
SECRET_NEAR = r"(?i)(token|secret|passw|passphrase|api.?key|access.?key|private.?key|auth|credential|bearer)"
_KEY = "[A-Za-z0-9+/_-]"
_NAMED = r"(?:token|secret(?!ar)|passw|passphrase|api.?key|access.?key|private.?key|auth(?!ors?\b)|credential)[a-z0-9_.-]{0,20}[\"']?\s{0,3}(?:=>|:=|==|=|:)\s{0,3}[\"']?"
#: A candidate: what is assigned to a name of secrets or follows 'bearer' (to the closing quote, or to white space or a character that shells
#: have quoted), of any length; or 16 and more characters of keys with digits and letters among them or a key's prefix, '=' only as padding.
CANDIDATE = (
    rf"(?<=[=:>\s\"'])(?<=(?i:{_NAMED}|bearer\s{{1,3}}))(?![\s=:>\"']|(?i:bearer|basic)\s)"
    r"(?:(?<=\")[^\"\n]+(?=\")|(?<=')[^'\n]+(?=')|[^\s\"'&;<>()|]*[^\s\"'&;<>()|,.\]}])"
    rf"|(?<!{_KEY})(?:(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])|(?={'|'.join(PREFIXES)})){_KEY}{{16,}}(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?"
)
HARMLESS_NEAR = r"(?i)(commit|sha-?\d*|digest|checksum|md5|etag|uuid|guid|hash|revision|build|version|isbn|session id|request id|image|file)"
HARMLESS_PATH = r"(?i)(test|example|sample|fixture|mock|demo|doc|vendor|lock)"

FEATURES = ["length", "digits", "uppers", "symbols", "hex", "distinct", "turns", "pairs", "dictionary", "prefix", "uuid", "runs", "path", "near_secret", "near_harmless", "assigned", "quoted"]


def features(candidate: Column, before: Column, after: Column, path: Column) -> list[Column]:
    """FEATURES of a candidate, the up to 40 characters before and 20 after it, and its path, as doubles."""
    n = F.greatest(F.lit(1), F.char_length(candidate))
    count = lambda rx: F.regexp_count(candidate, F.lit(rx)) / n
    flag = lambda text, rx: F.coalesce(text, F.lit("")).rlike(rx).cast("double")
    low = F.lower(candidate)
    out = [
        F.char_length(candidate), count("[0-9]"), count("[A-Z]"), count("[+/_=-]"), flag(candidate, "^[0-9a-fA-F]+$"),
        F.size(F.array_distinct(F.split(candidate, ""))) / n, count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        F.regexp_count(low, F.lit("(?=(?:" + "|".join(PAIRS) + "))")) / n, 1 - F.char_length(F.regexp_replace(low, "|".join(DICTIONARY), "")) / n,
        flag(candidate, "^(?:" + "|".join(PREFIXES) + ")"), flag(candidate, "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"),
        count(r"(.)(?=\1)"), flag(path, HARMLESS_PATH), flag(before, SECRET_NEAR), flag(before, HARMLESS_NEAR), flag(before, r"""[=:]\s*["']?$"""), flag(after, """^["']"""),
    ]
    return [c.cast("double").alias("f_" + name) for c, name in zip(out, FEATURES, strict=True)]


def labelled_findings(n: int = 1500, seed: int = 5) -> list[tuple[str, str, str, str, int]]:
    """Made-up labelled findings (before, candidate, after, path, label): n of each label. Where reviewed findings exist, use them instead."""
    r = random.Random(seed)
    pick = lambda chars, lo, hi: "".join(r.choice(chars) for _ in range(r.randint(lo, hi)))
    hexes, b64, up = "0123456789abcdef", string.ascii_letters + string.digits + "+/_-", string.ascii_uppercase + string.digits
    prose = lambda: " ".join(pick(string.ascii_lowercase, 2, 9) for _ in range(5)) + " "
    paths = ["src/main", "app/settings", "tests/unit", "docs/example", "src3", "conf/deploy"]

    def digit(x: str) -> str:
        return x if any(c.isdigit() for c in x) and any(c.isalpha() for c in x) else x + "a7"

    out = []
    for _ in range(n):
        name = r.choice(["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret"])
        quote = r.choice(['"', "'", ""])
        kind = r.randrange(8)
        if kind > 4:
            word = lambda: "".join(r.choice(PAIRS) for _ in range(r.randint(2, 4)))
            x = [word() + pick(string.digits, 1, 4) + pick(string.ascii_lowercase, 0, 3), "".join(word() for _ in range(r.randint(3, 5))), pick(string.ascii_letters + string.digits + "!@#$%", 8, 16)][kind - 5]
            shell = r.random() < 0.5
            before = prose() + ("\n" + r.choice(["DB_", "APP_", ""]) + name.upper() + "=" if shell else name + r.choice([" = ", "=", ": "]) + (quote := r.choice("\"'")))
            after = ("\n" if shell else quote + r.choice([" ", "\n"])) + prose()
            out.append((before[-40:], x, after[:20], r.choice(paths), 1))
            continue
        if kind < 2:
            x, before = digit(pick(hexes, 32, 64) if kind else pick(b64, 20, 48)), prose() + name + r.choice([" = ", "=", ": "]) + quote
            after = quote + r.choice([" ", "\n"]) + prose()
        else:
            p = r.choice(["AKIA", "AKIA", "ghp_", "sk_live_", "AIza", "xoxb-", "glpat-"])
            x = p + (pick(up, 16, 16) if p == "AKIA" else pick(string.ascii_letters + string.digits, 24, 40))
            before, after = (prose() if r.random() < 0.7 else prose() + name + " = " + quote), " " + prose()
        out.append((before[-40:], digit(x), after[:20], r.choice(paths), 1))
    for _ in range(n):
        kind, near = r.randrange(10), r.choice(["commit ", "sha256:", "md5 ", "etag: ", "checksum = ", "revision ", "digest "])
        before, after = prose(), " " + prose()
        if kind > 7:
            x = r.choice(["none", "None", "null", "true", "str", "string", "required", "self.token", "os.environ", "$TOKEN", "${SECRET}", pick(string.digits, 1, 4), pick(string.ascii_lowercase, 1, 7), r.choice(DICTIONARY)])
            before += r.choice(["token", "secret", "password", "api_key", "auth", "tokens"]) + r.choice([": ", ": ", " = ", "="])
            out.append((before[-40:], x, after[:20], r.choice(paths), 0))
            continue
        if kind == 0:
            x, before = pick(hexes, 32, 64), before + near
        elif kind == 1:
            h = pick(hexes, 32, 32)
            x, before = f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}", before + r.choice(["uuid ", "id ", "", "session id "])
        elif kind == 2:
            x = "_".join(r.sample(DICTIONARY, 3)) + "_" + pick(string.digits, 1, 6)
        elif kind == 3:
            x = r.choice(string.ascii_letters) * r.randint(14, 24) + pick(string.digits, 2, 4)
        elif kind == 4:
            x = "/".join([r.choice(DICTIONARY), pick(string.digits, 4, 4), pick(string.digits, 2, 2), r.choice(DICTIONARY) + pick(string.digits, 1, 5)])
        elif kind == 5:
            x = "your-" + r.choice(["token", "api-key", "secret"]) + "-here-" + pick(string.digits, 3, 6)
            before += "token = "
        elif kind == 6:
            x = f"20{pick(string.digits, 2, 2)}-{pick(string.digits, 2, 2)}-{pick(string.digits, 2, 2)}T{pick(string.digits, 6, 9)}Z"
        else:
            x = "".join(r.choice(PAIRS) for _ in range(r.randint(7, 14))) + pick(string.digits, 1, 3)
        out.append((before[-40:], digit(x) if len(digit(x)) > 15 else digit(x) + "0" * 16, after[:20], r.choice(paths), 0))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int = 5):
    """A tree: (feature, threshold, left, right), or the share of positives."""
    share = float(y.mean()) if len(y) else 0.5
    if depth == 0 or len(y) < 2 * least or share in (0.0, 1.0):
        return round(share, 4)
    best = None
    for f in rng.choice(x.shape[1], min(x.shape[1], max(1, int(np.sqrt(x.shape[1]))) + 1), replace=False):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1])[:: max(1, len(values) // 16)] / 2:
            left = x[:, f] <= cut
            n = int(left.sum())
            if n < least or len(y) - n < least:
                continue
            p, q = y[left].mean(), y[~left].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0]:
                best = (impurity, int(f), float(cut), left)
    if best is None:
        return round(share, 4)
    _, f, cut, left = best
    return f, cut, grow(x[left], y[left], rng, depth - 1, least), grow(x[~left], y[~left], rng, depth - 1, least)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 15, depth: int = 5, seed: int = 3) -> list:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(x[rows], y[rows], rng, depth))
    return out


def _tree_column(node) -> Column:
    if not isinstance(node, tuple):
        return F.lit(float(node))
    f, cut, left, right = node
    return F.when(F.col("f_" + FEATURES[f]) <= cut, _tree_column(left)).otherwise(_tree_column(right))


def score_column(trees: list) -> Column:
    """The forest as an expression over the feature columns."""
    return sum((_tree_column(t) for t in trees), F.lit(0.0)) / len(trees)


def train(spark, findings: list[tuple[str, str, str, str, int]] | None = None, most: int = 10_000) -> list:
    """A forest from labelled findings (before, candidate, after, path, label), at most `most` of them; what the scan finds in each as a text, or
    if it finds nothing the finding itself, gives the features."""
    rows = (labelled_findings() if findings is None else findings)[:most]
    df = spark.createDataFrame([(i, (b or "") + c + (a or ""), b, c, a, p, y) for i, (b, c, a, p, y) in enumerate(rows)], "doc_id long, text string, b string, c string, a string, path string, label int")
    own = F.filter("found", lambda f: f["candidate"].contains(F.col("c")) | F.col("c").contains(f["candidate"]) & (F.char_length(f["candidate"]) * 2 > F.char_length("c")))
    met = candidates(df, "path").select("doc_id", "found").join(df, "doc_id").withColumn("own", own)
    f = F.coalesce(F.get(F.reverse("own"), F.lit(0)), F.struct(F.col("c").alias("candidate"), F.col("b").alias("before"), F.col("a").alias("after")))
    df = met.withColumn("f", f).orderBy("doc_id")
    got = df.select(*features(F.col("f.candidate"), F.col("f.before"), F.col("f.after"), F.col("path")), "label").collect()
    data = np.array([tuple(r) for r in got], float)
    return forest(data[:, :-1], data[:, -1])


def candidates(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, th (hash of text), path, found array<struct<candidate, before, after>>."""
    text = F.coalesce(F.col("text"), F.lit(""))
    t = docs.select("doc_id", F.xxhash64("text").alias("th"), F.col(path).alias("path"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("c"), text.alias("text"))
    between = F.split("text", CANDIDATE, -1)
    tail, head = lambda s: F.substring(s, -40, 40), lambda s: F.substring(s, 1, 20)
    near = lambda i: F.when(i > 0, F.concat(F.get(F.col("around"), i - 1)["tail"], F.get("c", i - 1))).otherwise("")
    found = F.transform("c", lambda c, i: F.struct(c.alias("candidate"), tail(F.concat(near(i), F.get(F.col("around"), i)["tail"])).alias("before"), F.get(F.col("around"), i + 1)["head"].alias("after")))
    t = t.withColumn("around", F.when(F.size("c") > 0, F.transform(between, lambda s: F.struct(tail(s).alias("tail"), head(s).alias("head")))))
    return t.select("doc_id", "th", "path", found.alias("found"))


def scan(docs: DataFrame, trees: list, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_candidates int, n_secrets int, secrets array<struct<position int, candidate string, score double>>) for each distinct
    (doc_id, text, path) of docs: the candidates and those that the forest scores at `threshold` or more, by position
    among the candidates.

    The text between candidates gives the neighbouring words, before a candidate with the candidate there and the text before that. Null and empty texts have no candidates; equal candidates count
    each; a null path is an empty one; rows that repeat doc_id, text and path give one row; an empty table gives none; further
    columns are ignored. Whole texts are searched, and candidates may be of any length.
    """
    t = candidates(docs, path).select("doc_id", "th", "path", F.posexplode_outer("found").alias("position", "f")).distinct()
    t = t.select("doc_id", "th", "path", "position", F.col("f.candidate").alias("candidate"), *features(F.col("f.candidate"), F.col("f.before"), F.col("f.after"), F.col("path").alias("p")))
    t = t.withColumn("score", F.when(F.col("candidate").isNotNull(), score_column(trees)))
    secret = F.when(F.col("score") >= threshold, F.struct("position", "candidate", F.round("score", 6).alias("score")))
    out = t.groupBy("doc_id", "th", "path").agg(F.count("candidate").cast("int").alias("n_candidates"), F.array_sort(F.collect_list(secret)).alias("secrets"))
    return out.select("doc_id", "n_candidates", F.size("secrets").alias("n_secrets"), "secrets")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), train(spark))
