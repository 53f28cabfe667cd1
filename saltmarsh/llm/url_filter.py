"""URL filtering: rules on hosts and paths, and a classifier of segmented names.

Rules come first; the longest one that fits decides. Other urls are judged by their words: each
label of the host and each part of the path is split into words by Viterbi search over a unigram
model (``cheappills`` becomes ``cheap pills``), and multinomial naive Bayes scores the words. The unigram
model counts the words of all urls of the input and of the labelled ones; naive Bayes learns from labelled urls, a table or a list of bounded size.
The words of the input stay a table of any size: each distinct run of letters is joined with those that stand in it, and is split with these.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from types import MappingProxyType

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm._salted import salted_lookup
from saltmarsh.llm._store import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 4  # letters of a word that may stand within another
MAX_WORD = 24  # letters of the longest word of the model
RUN = re.compile(r"[^\W\d_]+")  # letters of any script

# What site names are made of, by topic, for training without labelled urls: general words of each trade. Fixed values.
UNWANTED_TOPICS = """
ads adserver adverts affiliate banner doubleclick pixel popup popunder retarget sponsor telemetry tracker tracking
adult amateur babes cams camgirls erotic escort fetish hentai hookup milf nude porn sex sexy webcam xxx
baccarat bet bets betting bingo blackjack bookie casino gamble gambling jackpot lottery poker roulette slots sportsbook wager
cialis diet drugs erection meds pharma pharmacy pills prescription rx slimming steroids tramadol viagra xanax
crack cracked keygen nulled pirate pirated serials torrent torrents warez
cash credit debt doubler forex loan loans lender payday profits rich
bots clickbait counterfeit fake giveaway hacked junk knockoff malware phishing prize replica scam spam spyware virus winner
"""
HARMLESS_TOPICS = """
academy adults books campus college course education examination language learn lesson library school student teacher university
bakery bread cafe coffee cooking farm food fruit garden kitchen market organic recipe restaurant tea wine
art culture festival film gallery heritage history museum music orchestra poetry theatre
airport bike bus city flight hotel island map mountain rail river tour train travel valley
athletics chess club cup football league marathon race rugby sports swim team tennis track
bulletin daily gazette herald journal magazine news post press radio review times tribune weather
app blog cloud code data developer docs forum hosting linux network open software tech wiki
bank charity church clinic council doctor family foundation health hospital nurse police public village
"""
#: Words that sites of either kind add to their names.
EITHER = """
all bargain best big bonus buy central cheap chat chats click clicks deal deals direct discount download easy express extra fast free galaxy games get go good guide
hot hub info instant land list live lucky mega mobile movie movies my net new now online party plus point pro quick room rooms secrets server shop site
smart spin spins spot star store stream super the tips today top tube video videos vip watch watches web win world zone
"""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without ``://`` and for null.

    Host: from behind the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case. Path: then up to ``?`` or ``#``.
    """
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def fitting_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest rule whose host is the url's or a parent of it and whose path begins the url's; its verdict."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):  # the longest one is asked first
        rule_host, rule_path = split_rule(rule)
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        which, verdict = F.when(fits, rule).otherwise(which), F.when(fits, rules[rule]).otherwise(verdict)
    return which, verdict


def training_urls() -> list[tuple[str, str, bool]]:
    """Labelled (host, path, blocked) by rule: each word of a topic with each other one of it, with itself, and with each word of either kind, joined by
    a hyphen. As unwanted sites also take on ordinary words, the first word of each of their topics is joined with all of these."""
    made, either = [], EITHER.split()
    for topics, blocked in ((UNWANTED_TOPICS, True), (HARMLESS_TOPICS, False)):
        for topic in topics.strip().splitlines():
            words = topic.split()
            made += [(f"{a}-{b}", "", blocked) for i, a in enumerate(words) for b in [*words[i:], *either]]
    leading = [topic.split()[0] for topic in UNWANTED_TOPICS.strip().splitlines()]
    return made + [(f"{a}-{b}", "", True) for a in leading for b in HARMLESS_TOPICS.split()]


def runs_of(host: str, path: str) -> list[str]:
    """The runs of letters of a url, in lower case."""
    return RUN.findall(f"{host} {path}".lower())


class Segmenter:
    """Unigram model of words; splits a run of letters into the likeliest words. ``others``: how often words come that are given with each run."""

    def __init__(self, counts: Counter[str], others: int = 0):
        self.total = sum(counts.values()) + others
        self.cost = {w: self.cost_of(n) for w, n in counts.items() if 0 < len(w) <= MAX_WORD}

    def cost_of(self, n: int) -> float:
        return -math.log(n / self.total)

    def unknown(self, n: int) -> float:
        """Cost of an unknown word of ``n`` letters: a long one costs less than its parts."""
        return math.log(self.total * 10) + n * math.log(10)

    def words(self, text: str, others: Mapping[str, float] = MappingProxyType({})) -> list[str]:
        """The words of a run; ``others``: costs of further words that stand in it."""
        best = [0.0]
        came = [0]
        for end in range(1, len(text) + 1):
            options = [(best[at] + cost, at) for at in range(max(0, end - MAX_WORD), end) if (cost := self.cost.get(text[at:end], others.get(text[at:end]))) is not None]
            options += [(best[at] + self.unknown(end - at), at) for at in range(max(0, end - MAX_WORD), end)]
            cost, at = min(options)
            best.append(cost)
            came.append(at)
        out, end = [], len(text)
        while end:
            out.append(text[came[end] : end])
            end = came[end]
        return out[::-1]


class UrlClassifier:
    """Multinomial naive Bayes over the words of host and path.

    ``corpus``: how often words come in urls that have no label. ``others``: how often those come in all that are a table instead, see ``weight_of``.
    """

    def __init__(self, labelled: Iterable[tuple[str, str, bool]], corpus: Iterable[tuple[str, int]] = (), alpha: float = 0.5, prior: float = 0.2, others: int = 0):
        counts = {True: Counter(), False: Counter()}
        for host, path, blocked in labelled:
            counts[blocked].update(RUN.findall(f"{host} {path}".lower()))
        self.labelled = counts[True] + counts[False]
        self.segmenter = Segmenter(self.labelled)
        self.segmenter = Segmenter(self.labelled + Counter({w: n for w, n in corpus if self.new(w)}), others)
        known = set(self.labelled)
        sums = {k: sum(c.values()) + alpha * len(known) for k, c in counts.items()}
        self.weight = {w: math.log((counts[True][w] + alpha) / sums[True]) - math.log((counts[False][w] + alpha) / sums[False]) for w in known}
        self.bias = math.log(prior / (1 - prior))
        self.of_run = lru_cache(100_000)(self.weight_of)

    def weight_of(self, run: str, others: Mapping[str, int] = MappingProxyType({})) -> float:
        """The weights of a run's words; a short one beside a part that is no word may be a part itself (ex, exam in example) and counts for nothing.

        ``others``: the words of the urls without label that stand in the run, and how often they come in all urls.
        """
        costs = {w: self.segmenter.cost_of(n) for w, n in others.items()}
        words = self.segmenter.words(run, costs)
        known = [True, *(w in self.segmenter.cost or w in costs for w in words), True]
        return sum(self.weight.get(w, 0.0) for i, w in enumerate(words) if len(w) > SHORT or (known[i] and known[i + 2]))

    def new(self, word: str) -> bool:
        """Whether a word of urls without label, of a model without any yet, adds to it."""
        return word not in self.labelled and not self._made_up(word)

    def _made_up(self, name: str) -> bool:
        """Whether labelled words, of three letters or more, make up a name; it is then no word of its own, however often it comes."""
        parts = self.segmenter.words(name)
        return len(parts) > 1 and all(len(w) > 2 and w in self.segmenter.cost for w in parts)

    def words(self, host: str, path: str) -> list[str]:
        return [w for run in runs_of(host, path) for w in self.segmenter.words(run)]

    def score(self, host: str, path: str) -> float:
        """Probability that the url is to be blocked."""
        return self.probability(map(self.of_run, runs_of(host, path)))

    def probability(self, weights: Iterable[float]) -> float:
        x = self.bias + sum(weights)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def corpus_words(df: DataFrame, url_col: str = "url", *, least: int = 3) -> DataFrame:
    """(word, n): the words of all urls, up to ``MAX_WORD`` letters, that come ``least`` times, and how often."""
    host, path = host_and_path(F.col(url_col))
    runs = F.regexp_extract_all(F.lower(F.concat_ws(" ", host, path)), F.lit(r"(\p{L}+)"), F.lit(1))
    words = df.select(F.explode(runs).alias("word")).filter(F.length("word") <= MAX_WORD).groupBy("word").agg(F.count("*").alias("n"))
    return words.filter(F.col("n") >= least)


def run_weights(runs: DataFrame, words: DataFrame, learned_from: list[tuple[str, str, bool]]) -> DataFrame:
    """(run, weight) of distinct ``runs``, each split with the labelled words and with those of ``words`` (word, n) that stand in it.

    ``words`` may have any number of rows; the driver gets the sum of their ``n`` only.
    """
    spark = runs.sparkSession
    held = spark.sparkContext.broadcast(learned_from)

    @F.pandas_udf("boolean")
    def new(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = UrlClassifier(held.value)
        for part in parts:
            yield part.map(model.new).astype(bool)

    words = stored(words.filter(new("word")), "url_words")
    total = words.agg(F.sum("n")).first()[0] or 0

    @F.pandas_udf("array<string>")
    def pieces(column: pd.Series) -> pd.Series:
        return column.map(lambda run: list({run[i:j] for i in range(len(run)) for j in range(i + 1, min(len(run), i + MAX_WORD) + 1)}))

    standing = salted_lookup(runs.select("run", F.explode(pieces("run")).alias("word")), words, "word", ["run"]).filter("n IS NOT NULL")
    standing = standing.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("found"))  # no more than a run has pieces

    @F.pandas_udf("double")
    def weight(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = UrlClassifier(held.value, others=total)
        for part in parts:
            yield pd.Series([model.weight_of(run, {} if w is None else dict(zip(w, n, strict=True))) for run, w, n in zip(*part, strict=True)], dtype="float64")

    return runs.join(standing, "run", "left").select("run", weight("run", "found.word", "found.n").alias("weight"))


def labelled_from(df: DataFrame, *, max_rows: int = 100_000) -> list[tuple[str, str, bool]]:
    """Labelled urls (host, path, blocked) of a table: ``max_rows`` of them at most, those with the smallest hash; rows with a null label count for nothing."""
    rows = df.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "blocked").dropna(subset=["blocked"])
    return [tuple(r) for r in rows.orderBy(F.xxhash64("host", "path"), "host", "path", "blocked").limit(max_rows).collect()]


def judge_urls(
    df: DataFrame,
    rules: dict[str, str],
    labelled: list[tuple[str, str, bool]] | DataFrame | None = None,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    threshold: float = 0.5,
) -> DataFrame:
    """Id, ``host``, ``path``, ``rule``, ``verdict`` and ``score`` of each row.

    ``rules``: allow or block by ``host/path``; a bounded list, kept in the plan. ``labelled``: (host,
    path, blocked) to train from, as a table or a list, ``training_urls()`` if not given; see ``labelled_from`` for the bound of a table. A url
    without words that the model knows gets the prior and is allowed. Repeated rows and null ids are rows
    like others; null urls have an empty host and path; very long urls are read whole; further columns aren't read; no rows give no rows.
    """
    learned_from = labelled_from(labelled) if isinstance(labelled, DataFrame) else labelled or training_urls()
    host, path = host_and_path(F.col(url_col))
    rows = df.select(F.col(id_col), host.alias("host"), path.alias("path"), F.struct(host.alias("host"), path.alias("path")).alias("site"))

    @F.pandas_udf("array<string>")
    def runs(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([runs_of(h, p) for h, p in zip(hosts, paths, strict=True)], dtype="object")

    sites = stored(rows.select("site", "host", "path").distinct().select("site", F.posexplode_outer(runs("host", "path")).alias("at", "run")), "url_runs")
    weights = run_weights(sites.select("run").dropna().distinct(), corpus_words(df, url_col), learned_from)
    told = salted_lookup(sites, weights, "run", ["site"]).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("runs"))
    held = df.sparkSession.sparkContext.broadcast(learned_from)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = UrlClassifier(held.value)
        for part in parts:
            yield pd.Series([model.probability(w) for w in part], dtype="float64")

    scores = told.select("site", scored(F.filter("runs.weight", lambda x: x.isNotNull())).alias("score"))
    rows = salted_lookup(rows, scores, "site", [id_col]).drop("site")
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
