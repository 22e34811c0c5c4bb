"""6. Secret scans: candidates found by shape, judged by a random forest. Native.

A candidate is a run of at least SHORTEST key characters inside a word, or a value of any length and characters that a
word gives to a key name (in the same word or after one that ends in = or :) or that is the user part of a URL (the
password, or the user where there is none). A value ends with its word. Its features are length, shares of character
kinds, character transitions, the share covered by dictionary words, the path and the neighbouring words. The forest is
trained from labelled findings; where none are given, a bounded sample of the corpus's own candidates is labelled by
formats (a key prefix, an assignment to a name such as token or password, a URL's user part), up to half the bound for
either label, and made-up findings are added, which are labelled by what they were made as: short secrets, and hard
negatives (hashes, UUIDs, integrity values, encoded data, paths and names) beside long secrets of the same letters. Dictionary words are the
most frequent ones of all documents. The trained trees become one expression, so scanning is a projection: no shuffle, and
a candidate costs a few comparisons.

Defined results: a null or empty text has no candidates; a null path is empty; null doc_ids and repeated rows are scanned
as rows of their own; without findings of both kinds to learn from, every candidate scores the one kind's label (0 if
there are none).
"""

from __future__ import annotations

import random
import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgspark.llm.common import documents, stored, table, words

SHORTEST = 16
SHAPE = f"[A-Za-z0-9+/_-]{{{SHORTEST},}}"
#: Findings to learn from, at most; words of the dictionary.
SAMPLE, DICTIONARY = 20_000, 150
TREES, DEPTH, SEED = 15, 5, 7
NAMES = "(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api_?-?key|apikey|auth|bearer|credential|private_?key|access_?key)"
TESTS = "(?i)(?:test|example|sample|mock|fixture)"
PREFIXED = "^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^sk-[A-Za-z0-9_-]{20,}$"
#: Names whose values are candidates; ways to assign; a value in a word, and a URL's user part.
KEYS = "(?i)(?:token|secret|passw(?:or)?d|passwd|passphrase|passcode|pwd|api[_-]?key|auth(?!or)|bearer|credential|private[_-]?key|access[_-]?key)"
GIVES = "[\\w.-]*[\"'`\\])]*(?:=>|:=|=+|:)"
VALUE = "[\"'`(\\[]*([^\\s\"'`]+)"
KEYED, AFTER_KEY = KEYS + GIVES + VALUE, KEYS + "[\\w.-]*[\"'`\\])]*\\s?(?:=>|:=|=+|:)$"
USER, BARE_USER = "://[^\\s/:@]*:([^\\s/]+)@", "://([^\\s/:@]+)@"
IN_URL = "://[^\\s/:@]*:$"
CLOSING = "[.,;:)\\]}>]+$"
#: Values that only stand for a secret.
STAND_IN = "(?i)^[$<{%(\\[*]|[(]|^(?:null|none|nil|true|false|changeme|required|optional|hidden|redacted|password|secret|token|x+)$"
REDACTED = "[REDACTED]"


def candidates(text: Column) -> Column:
    """array<struct<nth, value, before, lead, after>>: place of the word, the run, the two words before, the word's own
    beginning, the word after."""
    w = words(text)

    def found(w: Column) -> Column:
        def near(i: Column) -> Column:
            return F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1))

        def follows(i: Column) -> Column:
            return F.rlike(F.get(w, i - 1), F.lit("[=:>]$")) & F.rlike(near(i), F.lit(AFTER_KEY))

        def wanted(i: Column) -> Column:
            word = F.get(w, i)
            return (F.length(word) >= SHORTEST) & F.rlike(word, F.lit(SHAPE)) | F.rlike(word, F.lit(f"{KEYED}|{USER}|{BARE_USER}")) | F.coalesce(follows(i), F.lit(False))

        def values(i: Column) -> Column:
            word = F.get(w, i)
            after = F.when(follows(i), F.regexp_extract_all(word, F.lit("^" + VALUE), F.lit(1))).otherwise(F.array().cast("array<string>"))
            given = F.concat(after, F.regexp_extract_all(word, F.lit(KEYED), F.lit(1)))
            given = F.transform(given, lambda v: F.regexp_replace(v, CLOSING, ""))
            given = F.concat(given, F.regexp_extract_all(word, F.lit(USER), F.lit(1)), F.regexp_extract_all(word, F.lit(BARE_USER), F.lit(1)))
            runs = F.regexp_extract_all(word, F.lit(SHAPE), F.lit(0))
            # Runs may repeat; a value that is a run is that run.
            return F.concat(F.array_except(F.filter(given, lambda v: v != ""), runs), runs)

        at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), wanted)
        return F.flatten(
            F.transform(
                at,
                lambda i: F.transform(
                    values(i),
                    lambda v: F.struct(
                        i.alias("nth"), v.alias("value"), near(i).alias("before"),
                        F.left(F.get(w, i), F.instr(F.get(w, i), v) - 1).alias("lead"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("after"),
                    ),
                ),
            )
        )

    # One element, so that the words are split once.
    some = F.rlike(text, F.lit(SHAPE)) | F.rlike(text, F.lit(KEYS + "[^\\s]*\\s*(?:=>|:=|=+|:)")) | F.rlike(text, F.lit("://[^\\s/]+@"))
    return F.when(some, F.get(F.transform(F.array(w), found), F.lit(0)))


def features(x: Column, path: Column, dictionary: str) -> Column:
    """array<double> of a candidate."""
    v, near = x["value"], F.concat_ws(" ", x["before"], x["lead"])
    n = F.length(v).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(v, F.lit(pattern)) / n

    def flag(c: Column) -> Column:
        return c.cast("double")

    return F.array(
        n,
        share("[0-9]"), share("[A-Z]"), share("[+/_-]"), share("[aeiouAEIOU]"),
        share("(?<=[0-9])[A-Za-z]|(?<=[A-Za-z])[0-9]"), share("(?<=[a-z])[A-Z]|(?<=[A-Z])[a-z]"), share("(?<=[aeiou])[b-df-hj-np-tv-z]"), share("(?<=[b-df-hj-np-tv-z]{2})[b-df-hj-np-tv-z]"),
        F.size(F.array_distinct(F.split(v, ""))) / n,
        F.lit(1.0) - F.length(F.regexp_replace(F.lower(v), F.lit(dictionary), F.lit(""))) / n,
        flag(F.rlike(near, F.lit(NAMES))), flag(F.rlike(near, F.lit("[=:]\\s*[\"']?$"))), flag(F.rlike(x["lead"], F.lit("[\"'`]$"))),
        flag(F.rlike(x["after"], F.lit("^[a-z]+[.,]?$"))), flag(F.rlike(path, F.lit(TESTS))),
        share("[^A-Za-z0-9+/_-]"), flag(F.rlike(x["lead"], F.lit(IN_URL))), flag(F.rlike(v, F.lit(STAND_IN))),
    )


def format_label(x: Column) -> Column:
    """1 for candidates of a secret format, else 0."""
    near, v = F.concat_ws(" ", x["before"], x["lead"]), x["value"]
    mixed = F.rlike(v, F.lit("[0-9]")) & F.rlike(v, F.lit("[A-Za-z]"))
    odd = F.rlike(v, F.lit("[A-Za-z]")) & F.rlike(v, F.lit("[!#$%&*?@^~]"))
    given = F.rlike(near, F.lit(NAMES + "\\S*\\s*[=:]>?\\s*[\"'`]?$")) & (mixed | odd & (F.length(v) >= 6))
    return (F.rlike(v, F.lit(PREFIXED)) | (given | F.rlike(x["lead"], F.lit(IN_URL))) & ~F.rlike(v, F.lit(STAND_IN))).cast("int")


def made_up(n: int = 400) -> list[tuple[str, int]]:
    """``n`` texts with a short secret (1) and as many with a value that is none (0)."""
    draw = random.Random(SEED)
    small = "abcdefghijklmnopqrstuvwxyz"
    every = small + small.upper() + "0123456789"
    plain = "required optional hidden none null true false the is was below above empty changeme string value see ask expired valid missing ${DB_PASSWORD} <password> {{secret}} %s $TOKEN getpass() ****".split()
    frames = ['{} = "{}"', "{}='{}'", '{}="{}",', "{}: {}", "{}={}", "{} := {}"]
    rows = []
    for i in range(n):
        name = draw.choice(["password", "passwd", "pwd", "api_key", "token", "secret", "db_password", "auth_token", "access_key"])
        length = draw.randint(6, 20)
        v = "".join(draw.choice(every) for _ in range(length - 1)) + draw.choice("0123456789")
        if i % 2:
            v = v[: length // 2] + draw.choice("!#$%&*?@^~-") + v[length // 2 :]
        if i % 4 < 2:
            stem = "".join(draw.choice(small) for _ in range(draw.randint(4, 8)))
            v = stem + draw.choice(["", "!", "-", "#", "&", "_"]) + str(draw.randint(1, 9999))
        v = draw.choice(small) + v  # no stand-in, and a letter
        no = draw.choice(plain) if draw.random() < 0.6 else "".join(draw.choice(small) for _ in range(draw.randint(3, 9)))
        if i % 5 == 4:
            rows += [(f"see postgres://app:{v.replace('@', '!')}@db/x here", 1), (f"see ftp://{no.strip('<>') if no.isalpha() else 'anonymous'}@host/x here", 0)]
        else:
            rows += [(f"Set {draw.choice(frames).format(name, v)} there.", 1), (f"Set {draw.choice(frames).format(name, no)} there.", 0)]
    return rows


#: Contexts of values that are no secrets although they look like one ({} is the value), by kind; those of secrets.
NO_SECRETS = {
    "hash": ["commit {} fixed it", "merged {} into main", "see revision {} for this", "sha1 {} was built", 'checksum = "{}"', "digest: sha256:{}", "md5: {} of the file", 'etag: "{}"', "HEAD is now at {}", "parent {} of it"],
    "uuid": ["request {} took long", "id={}", 'uuid: "{}"', "session_id={} ended", "/objects/{}/parts", "trace {} shows it"],
    "integrity": ['integrity="sha256-{}="', 'integrity="sha512-{}=="', '"integrity": "sha384-{}"', "script-src 'sha256-{}='"],
    "data": ["data:image/png;base64,{}", "src=data:font/woff2;base64,{} is inline", "body: {}", "payload {} follows"],
    "name": ["call {} first", "import {} here", "open {} now", "class {} extends it"],
}
SECRETS = {
    "hex": ['token = "{}"', "API_KEY={}", "password={}", 'secret: "{}"', "auth_token: {}", "access_key={}"],
    "mixed": ['api_key = "{}"', "Authorization: Bearer {}", 'client_secret="{}"', "export SECRET_TOKEN={}", "private_key: '{}'", "--token={}"],
    "prefixed": ["key {} is in use", "use {} here", 'id = "{}"', "{} leaked", "found {} in logs"],
}


def made_findings(n: int = 3000, seed: int = SEED, take: slice = slice(None)) -> list[tuple[str, int]]:
    """``n`` texts with a long value that is a secret (1) or none (0), half each, in the contexts of each kind that ``take``
    names. A label says which the value was made as, not what it looks like: the same hex digits are made as both."""
    draw = random.Random(seed)
    small, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = small + small.upper() + digits
    syllables = "get set load find node list path user item text file name page view test data form base link main".split()

    def some(letters: str, k: int, few: bool = False) -> str:
        if few:  # keys of examples and tests have few different letters
            letters = draw.sample(letters, draw.choice([2, 4, 8]))
        return "".join(draw.choice(letters) for _ in range(k))

    def key() -> str:
        few = draw.random() < 0.5
        kinds = ("AKIA", small.upper() + digits, 16), ("ghp_", every, 36), ("xoxb-" + some(digits, 12) + "-", every, 24), ("sk-", every, 40)
        start, letters, k = draw.choice(kinds)
        return start + some(letters, k, few)

    def hexed(k: int) -> str:
        return some(digits + "abcdef", k)

    def name() -> str:
        parts = [draw.choice(syllables) for _ in range(draw.randint(5, 8))]
        return draw.choice(["/".join(parts), "_".join(parts), "_".join(parts).upper(), parts[0] + "".join(p.title() for p in parts[1:]), "-".join(parts)])

    values = {
        "hash": lambda: hexed(draw.choice([32, 40, 40, 64])),
        "uuid": lambda: "-".join(map(hexed, (8, 4, 4, 4, 12))),
        "integrity": lambda: some(every + "+/", draw.choice([43, 64, 86])),
        "data": lambda: some(every + "+/", draw.randint(40, 200)),
        "name": name,
        "hex": lambda: hexed(draw.choice([16, 24, 32, 40, 64])),
        "mixed": lambda: some(every + draw.choice(["", "-_", "+/"]), draw.randint(20, 64)),
        "prefixed": key,
    }
    rows = []
    for i in range(n):
        kinds = SECRETS if i % 2 else NO_SECRETS
        kind = draw.choice(sorted(kinds))
        rows.append((f"It says {draw.choice(kinds[kind][take]).format(values[kind]())} there.", i % 2))
    return rows


def labelled(docs: DataFrame, path: str, sample: int = SAMPLE) -> DataFrame:
    """Findings labelled by format: x (a candidate), path, label; of each label those with the smallest hashes, together at
    most ``sample``, so that rare secrets are learnt from however many other candidates there are; and the made-up ones, whose
    labels no format gives."""
    rows = documents(docs, path).select(F.coalesce(path, F.lit("")).alias("path"), F.explode(candidates(F.col("text"))).alias("x"))
    rows = stored(rows.withColumn("label", format_label(F.col("x"))), "candidates")
    some = [rows.where(F.col("label") == label).orderBy(F.xxhash64("x"), "x").limit(sample // 2) for label in (0, 1)]
    rows = some[0].union(some[1])
    made = docs.sparkSession.createDataFrame(made_up() + made_findings(), "text string, label int").select(F.lit("").alias("path"), F.explode(candidates(F.col("text"))).alias("x"), "label")
    return rows.union(made)


def frequent(docs: DataFrame, n: int = DICTIONARY) -> list[str]:
    """The ``n`` most frequent words of all documents, of at least three letters."""
    raw = docs.select(F.explode(words(F.coalesce("text", F.lit("")))).alias("raw")).where(F.length("raw") >= 3).groupBy("raw").count()
    return _top(raw.select("raw", "count"), n)


def _top(raw: DataFrame, n: int) -> list[str]:
    clean = raw.select(F.lower(F.regexp_replace("raw", "[^\\p{L}]", "")).alias("word"), "count").where(F.length("word") >= 3)
    return [r.word for r in clean.groupBy("word").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "word").limit(n).collect()]


class Forest:
    """A fitted forest: the dictionary as a pattern, and its trees as (feature, threshold, below, above) or a vote."""

    def __init__(self, dictionary: str, trees: list, model=None):
        self.dictionary, self.trees, self.model = dictionary, trees, model

    def score(self, f: Column) -> Column:
        """The share of trees for "secret"."""

        def vote(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, below, above = node
            return F.when(F.get(f, F.lit(feature)) <= threshold, vote(below)).otherwise(vote(above))

        votes = [vote(t) for t in self.trees]
        return sum(votes[1:], votes[0]) / len(votes)


def fit(findings: DataFrame, docs: DataFrame | None = None) -> Forest:
    """Train on labelled findings (x, path, label). The dictionary is that of ``docs``, or of the findings' neighbours."""
    rows = findings.select("x", "path", "label").persist()
    try:
        counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        near = rows.select(F.explode(F.split(F.concat_ws(" ", "x.before", "x.after"), " ")).alias("raw")).groupBy("raw").count()
        top = _top(near, DICTIONARY) if docs is None else frequent(docs)
        dictionary = "|".join(re.escape(w) for w in sorted(top, key=lambda w: (-len(w), w))) or "(?!)"
        if set(counts) != {0, 1}:
            return Forest(dictionary, [max(counts, default=0)])
        ready = rows.select(array_to_vector(features(F.col("x"), F.col("path"), dictionary)).alias("features"), F.col("label").cast("double").alias("label"))
        model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(ready)
    finally:
        rows.unpersist()
    return Forest(dictionary, [_tree(t._call_java("rootNode")) for t in model.trees], model)


def _tree(node):
    if "Leaf" in node.getClass().getSimpleName():
        return node.prediction()
    split = node.split()
    return split.featureIndex(), split.threshold(), _tree(node.leftChild()), _tree(node.rightChild())


def secret_scan(docs: DataFrame, *keep: str, path: str = "source", forest: Forest | None = None) -> DataFrame:
    """doc_id, ``keep``, text, findings: array<struct<nth, value, score, secret>> for every row."""
    forest = forest or fit(labelled(docs, path), docs)
    rows = documents(docs, *dict.fromkeys([*keep, path])).withColumn("findings", candidates(F.col("text")))
    place = F.coalesce(path, F.lit(""))
    rows = rows.withColumn("findings", F.transform("findings", lambda x: F.struct(x["nth"].alias("nth"), x["value"].alias("value"), features(x, place, forest.dictionary).alias("f"))))
    rows = rows.withColumn("findings", F.transform("findings", lambda x: F.struct(x["nth"].alias("nth"), x["value"].alias("value"), forest.score(x["f"]).alias("score"))))
    judged = F.transform("findings", lambda x: F.struct(x["nth"].alias("nth"), x["value"].alias("value"), x["score"].alias("score"), (x["score"] >= 0.5).alias("secret")))
    return rows.select("doc_id", *keep, "text", F.coalesce(judged, F.array().cast("array<struct<nth:int,value:string,score:double,secret:boolean>>")).alias("findings"))


def redacted(text: Column, findings: Column) -> Column:
    """The text with every secret found in it blanked out; short ones only where they are not part of a longer word."""

    def without(t: Column, v: Column) -> Column:
        alone = F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![A-Za-z0-9])"))
        return F.when(F.length(v) >= SHORTEST, F.replace(t, v, F.lit(REDACTED))).otherwise(F.regexp_replace(t, alone, F.lit(REDACTED)))

    # Longer ones first, as a shorter one may be their beginning.
    found = F.transform(F.filter(findings, lambda x: x["secret"]), lambda x: F.struct((-F.length(x["value"])).alias("n"), x["value"].alias("value")))
    return F.aggregate(F.array_sort(F.array_distinct(found)), text, lambda t, x: without(t, x["value"]))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("findings").alias("x")).select("doc_id", F.col("x.nth").cast("long").alias("nth_word"), F.col("x.value").alias("value"), F.col("x.score").alias("score"), F.col("x.secret").alias("is_secret"))
