"""Short beat-aligned passages nested in sections.

A section is cut at every n-th beat inside it, but only where the new passage would last the
minimum; a cut that leaves too short a tail is taken back. Whether a beat is used depends on the
cut accepted before it, so the cuts of a section form a chain.

The chain is followed without gathering a section's beats in one place. Beats are grouped into
time runs (one shuffle, written to the checkpoint folder). Each run states what it would do for every cut
that could be the first one accepted in it, one short entry per candidate in the run's first
``minimum`` seconds. Folding those statements over a section's runs, at most about ``MAX_RUNS``
of them, gives the last cut before each run, and the runs then emit their passages independently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from songframe.operators import timeline as TL
from songframe.operators.joins import attach, points_in_intervals
from songframe.operators.ordered import with_running_total
from songframe.session import cut_lineage

# A run lasts this many minimum lengths, or longer where a section would have too many runs.
RUN_MINIMUMS = 64
MAX_RUNS = 512
# Cell width of the beat-in-section join, in seconds.
CELL_SECONDS = 32.0

KEYS = ["recording_id", "hypothesis_id"]
SECTION = [*KEYS, "section_index"]


def check_settings(**settings: float) -> None:
    """Refuse cuts without a step: every setting has to be above zero (``rules.passage_rules``)."""
    wrong = {name: value for name, value in settings.items() if not value > 0}
    if wrong:
        raise ValueError(f"passages need settings above zero, got {wrong}")


def _follow(cuts: Column, last: Column, minimum: float) -> Column:
    """Accept every cut far enough from the one before: (last, previous, count)."""
    zero = F.struct(
        last.alias("last"), F.lit(None).cast("double").alias("previous"), F.lit(0).cast("bigint").alias("count")
    )
    return F.aggregate(
        cuts,
        zero,
        lambda acc, cut: F.when(
            cut - acc["last"] >= minimum,
            F.struct(
                cut.alias("last"),
                F.when(acc["count"] > 0, acc["last"]).alias("previous"),
                (acc["count"] + 1).alias("count"),
            ),
        ).otherwise(acc),
    )


def _accepted(cuts: Column, last: Column, minimum: float) -> Column:
    """The accepted cuts themselves, in order."""
    empty = F.array().cast("array<double>")
    zero = F.struct(last.alias("last"), empty.alias("cuts"))
    return F.aggregate(
        cuts,
        zero,
        lambda acc, cut: F.when(
            cut - acc["last"] >= minimum,
            F.struct(cut.alias("last"), F.concat(acc["cuts"], F.array(cut)).alias("cuts")),
        ).otherwise(acc),
        lambda acc: acc["cuts"],
    )


def beat_runs(
    sections: DataFrame, beats: DataFrame, minimum_seconds: float
) -> DataFrame:
    """Beats strictly inside each section as one sorted array per (section, run)."""
    length = F.col("end_seconds") - F.col("start_seconds")
    sized = sections.withColumn(
        "run_seconds",
        F.greatest(F.lit(RUN_MINIMUMS * minimum_seconds), length / F.lit(float(MAX_RUNS))),
    )
    inside = points_in_intervals(
        beats.select(*KEYS, "seconds"),
        sized.select(*SECTION, "start_seconds", "end_seconds", "run_seconds"),
        KEYS,
        "seconds",
        "start_seconds",
        "end_seconds",
        CELL_SECONDS,
    )
    run = F.floor((F.col("seconds") - F.col("start_seconds")) / F.col("run_seconds"))
    return (
        inside.withColumn("run", run.cast("bigint"))
        .groupBy(*SECTION, "run", "start_seconds", "end_seconds", "run_seconds")
        .agg(F.sort_array(F.collect_list("seconds")).alias("beats"))
    )


def passage_cuts(
    sections: DataFrame, beats: DataFrame, beats_per_passage: int = 8, minimum_seconds: float = 4.0
) -> DataFrame:
    """(section keys, label, passage_index, start_seconds, end_seconds) of every passage.

    ``passage_index`` runs over the whole recording.
    """
    check_settings(beats_per_passage=beats_per_passage, minimum_seconds=minimum_seconds)
    n, minimum = int(beats_per_passage), float(minimum_seconds)
    # Written once to the checkpoint folder: four later steps read it.
    runs = cut_lineage(beat_runs(sections, beats, minimum))

    # Every n-th beat of the section, counted across runs.
    # A section has a bounded number of runs, so this window is short; beats stay out of it.
    earlier = Window.partitionBy(*SECTION).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    counted = runs.select(
        *SECTION, "run",
        F.coalesce(F.sum(F.size("beats").cast("bigint")).over(earlier), F.lit(0)).alias("beats_ahead"),
    )
    candidates = runs.join(counted, [*SECTION, "run"]).withColumn(
        "cuts",
        F.filter(
            "beats", lambda b, i: (F.col("beats_ahead") + i.cast("bigint") + 1) % F.lit(n) == 0
        ),
    ).filter(F.size("cuts") > 0).drop("beats")

    # What a run does, given the cut it accepts first.
    # A little slack keeps the list complete where run edges round differently.
    slack = minimum * 1.01
    run_start = F.col("start_seconds") + F.col("run") * F.col("run_seconds")
    reachable = F.filter(
        "cuts",
        lambda cut, i: (i == 0) | (F.get(F.col("cuts"), i - 1) - run_start < slack),
    )
    outcomes = candidates.withColumn(
        "outcomes",
        F.transform(
            reachable,
            lambda first: F.struct(
                first.alias("first"),
                _follow(
                    F.filter("cuts", lambda cut: cut >= first), first - F.lit(minimum) - F.lit(1.0), minimum
                ).alias("exit"),
            ),
        ),
    )

    # Carry the last accepted cut over the runs of a section.
    state_type = "struct<last:double,previous:double,count:bigint>"
    entry_type = f"array<struct<run:bigint,state:{state_type}>>"
    start_state = F.struct(
        F.col("start_seconds").alias("last"),
        F.lit(None).cast("double").alias("previous"),
        F.lit(0).cast("bigint").alias("count"),
    ).cast(state_type)

    def step(acc, item):
        state = acc["state"]
        usable = F.filter(item["outcomes"], lambda o: o["first"] - state["last"] >= minimum)
        taken = F.get(usable, F.lit(0))["exit"]
        moved = F.struct(
            taken["last"].alias("last"),
            F.coalesce(taken["previous"], state["last"]).alias("previous"),
            (state["count"] + taken["count"]).alias("count"),
        ).cast(state_type)
        return F.struct(
            F.when(taken.isNull(), state).otherwise(moved).alias("state"),
            F.concat(
                acc["entries"], F.array(F.struct(item["run"].alias("run"), state.alias("state")))
            ).cast(entry_type).alias("entries"),
        )

    folded = (
        outcomes.groupBy(*SECTION)
        .agg(F.sort_array(F.collect_list(F.struct("run", "outcomes"))).alias("runs"))
        .join(sections.select(*SECTION, "start_seconds", "end_seconds", "label"), SECTION, "right")
        .withColumn(
            "fold",
            F.aggregate(
                F.coalesce("runs", F.array()),
                F.struct(start_state.alias("state"), F.array().cast(entry_type).alias("entries")),
                step,
            ),
        )
        .withColumn("final", F.col("fold.state"))
        # A tail shorter than the minimum joins the passage before it.
        .withColumn(
            "take_back",
            (F.col("final.count") > 0) & (F.col("end_seconds") - F.col("final.last") < minimum),
        )
        .withColumn(
            "kept", F.col("final.count") - F.when(F.col("take_back"), 1).otherwise(0)
        )
    )
    # One small row per section, again with several readers.
    folded = cut_lineage(folded.drop("runs"))
    # Passages of the earlier sections of the recording come first in its numbering.
    folded = with_running_total(
        folded, KEYS, "section_index", F.floor(F.col("section_index") / TL.RUN), F.col("kept") + 1, "ahead"
    )

    entering = folded.select(
        *SECTION,
        "label",
        "ahead",
        F.when(F.col("take_back"), F.col("final.last")).alias("dropped"),
        F.explode("fold.entries").alias("entry"),
    ).select(
        *SECTION, "label", "ahead", "dropped",
        F.col("entry.run").alias("run"), F.col("entry.state").alias("state"),
    )
    within = (
        candidates.select(*SECTION, "run", "cuts")
        .join(entering, [*SECTION, "run"])
        .withColumn("accepted", _accepted(F.col("cuts"), F.col("state.last"), minimum))
        .withColumn(
            "accepted",
            F.filter("accepted", lambda c: F.col("dropped").isNull() | (c < F.col("dropped"))),
        )
        .select(
            *SECTION, "label", "ahead", "state", "accepted",
            F.posexplode("accepted").alias("at", "cut"),
        )
        .select(
            *SECTION,
            "label",
            (F.col("ahead") + F.col("state.count") + F.col("at")).alias("passage_index"),
            F.when(F.col("at") == 0, F.col("state.last"))
            .otherwise(F.get(F.col("accepted"), F.col("at") - 1))
            .alias("start_seconds"),
            F.col("cut").alias("end_seconds"),
        )
    )
    tails = folded.select(
        *SECTION,
        "label",
        (F.col("ahead") + F.col("kept")).alias("passage_index"),
        F.when(F.col("take_back"), F.coalesce("final.previous", "start_seconds"))
        .otherwise(F.col("final.last"))
        .alias("start_seconds"),
        F.col("end_seconds"),
    )
    return within.unionByName(tails)


def stem_map(stems: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row per recording with its required stems as name -> (path, sha256)."""
    record = F.struct("path", "sha256")
    picked = stems.filter(F.col("stem").isin(*required)).groupBy("recording_id").agg(
        *[F.max(F.when(F.col("stem") == name, record)).alias(name) for name in required]
    )
    entries = F.array(*[F.struct(F.lit(name).alias("key"), F.col(name).alias("value")) for name in required])
    return picked.select(
        "recording_id",
        F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("aligned_stems"),
    )


def build_passages(
    sections: DataFrame,
    beats: DataFrame,
    recordings: DataFrame,
    meta: DataFrame | None = None,
    stems: DataFrame | None = None,
    beats_per_passage: int = 8,
    minimum_seconds: float = 4.0,
    required_stems: tuple[str, ...] = ("vocals", "drums", "bass", "other"),
) -> DataFrame:
    """Passages of every section, indexed, aligned to samples and frames, with their stems."""
    cuts = passage_cuts(sections, beats, beats_per_passage, minimum_seconds)
    aligned = TL.align_intervals(
        cuts.withColumnRenamed("label", "section_label"), recordings, meta, "passage_index"
    )
    if stems is None:
        return aligned
    return attach(aligned, stem_map(stems, required_stems), ["recording_id"], "passage_index")


def passage_violations(passages: DataFrame, durations: DataFrame) -> DataFrame:
    """Gaps, overlaps and uncovered ends of the passage timeline.

    The first passage has to start at exactly zero; every other joint has a tolerance.
    """
    general = TL.contiguity_violations(passages, durations, KEYS, "passage_index", "passages")
    first = passages.filter(
        (F.col("passage_index") == 0)
        & (F.col("start_seconds") != 0)
        & (F.abs("start_seconds") <= TL.X.TOLERANCE)
    ).select(
        *KEYS, *TL.violation("passages", "nonzero_start", F.col("passage_index"), F.col("start_seconds"))
    )
    return general.unionByName(first)
