"""One run from submissions to a report: Engine(settings).run(spark) or ``python -m affinis.engine root ... --result folder``."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.operators import clusters, frequency, tokens
from affinis.operators.compare import FILE_END, Comparison, Options, compare
from affinis.sources import report
from affinis.sources.files import scan_submissions
from affinis.sources.more import Settings, settings


@dataclass
class Result:
    """submissions (name, state, n_tokens), comparison, scored (a, b, similarity: the shown metric), clusters."""

    submissions: DataFrame
    comparison: Comparison
    scored: DataFrame
    clusters: DataFrame
    weighted: DataFrame | None

    def tables(self) -> dict[str, DataFrame]:
        out = {"comparisons": report.comparison_records(self.comparison), "topComparisons": report.metrics(self.comparison), "distribution": report.distribution(self.scored), "clusters": self.clusters, "submissions": self.submissions, "members": self.comparison.members}
        out["submissionMappings"] = report.identifiers(self.submissions)
        if self.comparison.base is not None:
            out["basecode"] = report.base_records(self.comparison)
        return out


class Engine:
    def __init__(self, chosen: Settings):
        self.settings = chosen

    def files(self, spark: SparkSession) -> DataFrame:
        s = self.settings
        roots = {r: False for r in s.old_roots} | {r: True for r in s.roots}
        return scan_submissions(spark, roots, suffixes=list(s.suffixes) or None, exclude=list(s.exclude), subdirectory=s.subdirectory)

    def run(self, spark: SparkSession, files: DataFrame | None = None, base: DataFrame | None = None) -> Result:
        """files: (submission, file, text, is_new), by default those under the roots; base: files of the base code."""
        s = self.settings
        least = s.min_match or tokens.min_match(list(s.languages))
        rows = tokens.submissions(tokens.tokenize(self.files(spark) if files is None else files, list(s.languages)))
        n = F.size(F.filter("tokens", lambda t: t != FILE_END))
        state = F.when(n == 0, "NOTHING_TO_PARSE").when(n < least, "TOO_SMALL").otherwise("VALID")
        listed = rows.select("name", state.alias("state"), n.alias("n_tokens"))
        if base is None and s.base_code:
            base = scan_submissions(spark, {s.base_code: True}, suffixes=list(s.suffixes) or None)
        base_tokens = tokens.submissions(tokens.tokenize(base, list(s.languages))) if base is not None else None
        options = Options(least, s.merging, s.neighbour, s.max_gap, s.required_merges)
        found = compare(rows.filter(n >= least), options, base_code=base_tokens)
        scored = found.metric(s.metric).filter(F.col("similarity") >= s.similarity_threshold)
        from affinis.operators.clustering import connected

        averages = found.metric("AVG").filter("similarity > 0")
        joined = averages if s.preprocessor != "THRESHOLD" else averages.filter(F.col("similarity") >= s.cluster_threshold)
        parts = connected(joined.select("a", "b"))
        how = {"cut": s.cluster_threshold, "linkage": s.linkage} if s.clustering == "AGGLOMERATIVE" else {}
        grouped = clusters.clustered(averages, parts, algorithm=s.clustering, preprocessor=s.preprocessor, **how)
        weighted = None
        if s.frequency:
            own = rows.select(F.col("name").alias("a"), F.col("tokens").alias("ta"))
            matches = found.pairs.select("a", "b", F.explode("tiles").alias("t")).join(own, "a").select("a", "b", F.slice("ta", F.col("t.start_a") + 1, F.col("t.length_a")).alias("tokens"))
            weighted = frequency.weighted_similarity(frequency.STRATEGIES[s.frequency](matches, least), found.pairs, s.weighting, s.weighting_factor)
        return Result(listed, found, scored, grouped, weighted)

    def shown(self, result: Result) -> DataFrame:
        """The most similar pairs, as many as the settings show (0 or less: all)."""
        return result.scored if self.settings.shown <= 0 else result.scored.limit(self.settings.shown)


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="affinis", description="Compares submissions and writes a report.")
    p.add_argument("roots", nargs="*")
    p.add_argument("--mode", choices=["run", "view", "run_and_view", "auto"], default="auto")
    p.add_argument("--config")
    p.add_argument("--old", nargs="*", dest="old_roots")
    p.add_argument("--language", nargs="*", dest="languages")
    p.add_argument("--base-code", dest="base_code")
    p.add_argument("--min-match", type=int, dest="min_match")
    p.add_argument("--result")
    p.add_argument("--merging", action="store_true", default=None)
    p.add_argument("--suffixes", nargs="*")
    given = vars(p.parse_args(args))
    mode = given.pop("mode")
    chosen = settings(given.pop("config"), **given)
    spark = SparkSession.builder.appName("affinis").getOrCreate()
    if mode == "auto":
        mode = "run" if chosen.roots else "view"
    if mode.startswith("run"):
        engine = Engine(chosen)
        result = engine.run(spark)
        if chosen.result:
            report.write_report(chosen.result, result.tables())
        else:
            engine.shown(result).show(50, False)
    if mode.endswith("view"):
        spark.read.json(f"{chosen.result}/topComparisons").orderBy(F.desc("AVG"), "a", "b").show(50, False)
    return 0


#: How a report is asked for: words must stand in a name, index:n picks a row, metric<n compares percents.
def viewer_filter(rows: DataFrame, query: str) -> DataFrame:
    """Rows (a, b, rank, and metrics as columns) that a filter text keeps. All comparisons must hold; of the names and
    index terms one must."""
    import re

    named, must = [], F.lit(True)
    for term in query.split():
        m = re.fullmatch(r"(\w+)(<=|>=|<|>)([\d.]+)%?", term)
        if m and m.group(1) in rows.columns:
            x, cut = 100 * F.col(m.group(1)), float(m.group(3))
            must = must & {"<": x < cut, ">": x > cut, "<=": x <= cut, ">=": x >= cut}[m.group(2)]
        elif term.startswith("index:") and term[6:].isdigit():
            named.append(F.col("rank") == int(term[6:]))
        else:
            named.append(F.lower("a").contains(term.lower()) | F.lower("b").contains(term.lower()))
    one = F.lit(not named)
    for n in named:
        one = one | n
    return rows.filter(must & one)


def viewer_sort(rows: DataFrame, by: str) -> DataFrame:
    """By a metric, ties by the other metrics, then by names."""
    others = [m for m in ("AVG", "MAX", "LONGEST_MATCH", "MAXIMUM_LENGTH") if m != by and m in rows.columns]
    return rows.orderBy(F.desc(by), *[F.desc(m) for m in others], "a", "b")


if __name__ == "__main__":
    raise SystemExit(main())
