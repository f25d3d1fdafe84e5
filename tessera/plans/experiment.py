"""An experiment from configuration to reports: preprocess, search, accept, merge, explain.

Every stage leaves its tables and a marker; the search keeps the results of each batch of candidates as it goes, so that a run which was
interrupted fits only what has no result yet. All files are written through the file system of the output folder."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import ExperimentConfig, load_config
from tessera.operators import consensus as C
from tessera.operators import explain as E
from tessera.operators import preprocess as P
from tessera.operators import quality as Q
from tessera.operators import reporting as X
from tessera.operators import sampling as S
from tessera.operators import scoring as R
from tessera.plans import search
from tessera.sources import tables as T

#: Candidates whose results are kept together.
BATCH = 16
_CLUSTERER, _METHOD = "clustering_name", "representation_name"


class Experiment:
    """run() searches candidates and continues with consensus, interpretation and reports; each can also be called alone."""

    def __init__(self, spark: SparkSession, config: ExperimentConfig):
        self.spark, self.config = spark, config
        self.folder = os.path.join(config.experiment.output_dir, config.experiment.name)

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str) -> Experiment:
        return cls(spark, load_config(path))

    @classmethod
    def from_output_dir(cls, spark: SparkSession, folder: str) -> Experiment:
        out = cls(spark, ExperimentConfig.model_validate(T.read_yaml(f"{folder}/state/config_snapshot.yaml")))
        out.folder = str(folder).rstrip("/")
        return out

    # ------------------------------------------------------------------------------------------------------ tables

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        T.write_table(df, self._path(name))
        return self._table(name)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def _has(self, name: str) -> bool:
        return T.exists(self._path(name))

    def _kept(self, kind: str) -> DataFrame | None:
        """All tables of a kind that batches have left, columns by name."""
        if not T.exists(f"{self.folder}/{kind}"):
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{kind}/*.parquet")

    def validate(self) -> dict:
        T.require_columns(self.raw(), [*self.config.data.column_schema.all(), *self.config.data.ids()])
        return {"columns": len(self.config.data.column_schema.all()), "candidates": len(self._grid(None))}

    def inspect_data(self) -> DataFrame:
        return T.table_profile(self.raw())

    def status(self) -> dict:
        return {s: T.read_stage(self.folder, s) for s in ("search", "consensus", "interpretation", "report")}

    def raw(self) -> DataFrame:
        return T.load_table(self.spark, self.config.data.path)

    def rows(self) -> DataFrame:
        """Every row with its position: by all its columns, ids included."""
        df, ids = self.raw(), self.config.data.ids()
        df = T.with_row_idx(df, df.columns)
        first = F.col(ids[0]).cast("string") if ids else F.col("row_idx").cast("string")
        return df.withColumn("row_id", first)

    def _roles(self) -> P.Roles:
        s = self.config.data.column_schema
        return P.Roles(s.continuous, s.binary, s.categorical, s.ordinal, self.config.data.ordinal_maps)

    def prepared(self, rows: DataFrame, transform: str, encoding: str) -> tuple[DataFrame, list[str]]:
        """(row_idx, features) and the features' names, all fitted on these rows as the configuration says."""
        m, p = self.config.data.missingness, self.config.preprocessing
        numbers = self.config.data.column_schema.continuous
        flags = [c for c in numbers if m.add_missing_indicators]
        if m.continuous_imputer != "median" and numbers:
            # the gaps are kept aside, as indicators tell of the data before they were filled
            gaps = rows.select("row_idx", *[F.col(c).isNull().alias(f"_gap_{c}") for c in flags])
            if m.continuous_imputer == "knn":
                rows = P.knn_impute(rows, "row_idx", numbers, m.knn.n_neighbors, m.knn.weights)
            else:
                rows = P.iterative_impute(rows, numbers, m.iterative.max_iter, initial=m.iterative.initial_strategy)
            any_gap = gaps.agg(*[F.max(f"_gap_{c}").alias(c) for c in flags]).first() if flags else {}
            flags = [c for c in flags if any_gap[c]]
            rows = rows.join(gaps, "row_idx") if flags else rows
        else:
            flags = []
        roles = self._roles()
        rare, variance = p.rare_category_collapse, p.variance_threshold
        points, names = P.preprocess(rows, roles, "row_idx", transform, encoding, m.add_missing_indicators, rare.min_frequency if rare.enabled else None, variance.threshold if variance.enabled else None, rare.replacement)
        if flags:
            # where the imputers' indicators belong: behind the numbers
            at = sum(n.startswith("continuous__") for n in names)
            extra = F.array(*[F.col(f"_gap_{c}").cast("double") for c in flags])
            points = points.join(rows.select("row_idx", extra.alias("_extra")), "row_idx").select("row_idx", F.concat(F.slice("features", 1, at), "_extra", F.slice("features", at + 1, max(1, len(names) - at))).alias("features"))
            names = [*names[:at], *[f"continuous__{c}__missing" for c in flags], *names[at:]]
        return points, names

    def features(self, rows: DataFrame, transform: str, encoding: str) -> DataFrame:
        return self.prepared(rows, transform, encoding)[0]

    def _grid(self, dataset: dict | None) -> list[dict]:
        c = self.config
        return search.candidate_grid(c.preprocessing.continuous_transforms, c.preprocessing.categorical_encoding, [m.model_dump() for m in c.representation.methods], [m.model_dump() for m in c.clustering.methods], dataset)

    # ------------------------------------------------------------------------------------------------------ search

    def search(self) -> DataFrame:
        """Fit what has no result yet, batch by batch, and write the registry with its verdicts."""
        c = self.config
        T.write_yaml(json.loads(c.model_dump_json()), f"{self.folder}/state/config_snapshot.yaml")
        rows = self._save(self.rows(), "rows") if not self._has("rows") else self._table("rows")
        dataset = T.fingerprint(rows)
        T.write_json(dataset, f"{self.folder}/state/dataset.json")
        grid = self._grid(dataset)
        if c.search.optuna.enabled:
            for family in dict.fromkeys(g["family"] for g in grid):
                self._study(family, [g for g in grid if g["family"] == family])
        else:
            done = self._completed()
            for variant in dict.fromkeys((g["transform"], g["encoding"]) for g in grid):
                own = [g for g in grid if (g["transform"], g["encoding"]) == variant and g["candidate_id"] not in done]
                for i in range(0, len(own), BATCH):
                    self._evaluate(own[i : i + BATCH])
        out = self._verdicts()
        T.mark_stage(self.folder, "search", candidates=out.count(), accepted=out.where("accepted").count())
        return out

    def _completed(self) -> set[str]:
        kept = self._kept("results")
        return {r.candidate_id for r in kept.select("candidate_id").distinct().collect()} if kept is not None else set()

    def _verdicts(self) -> DataFrame:
        c = self.config.evaluation
        kept = R.latest_per_candidate(self._kept("results"), "finished_at").drop("_n")
        a, s = c.acceptance, c.structure_constraints
        full = kept.where("search_stage = 'full_evaluated'")
        scored = R.with_utilities(full, a.weighted_score)
        gated = R.gate_where_unknown(scored, a.hard_thresholds, a.weighted_score, k_min=s.min_clusters, k_max=s.max_clusters, min_fraction=s.min_cluster_fraction, max_noise=s.max_noise_fraction, max_dominant=s.dominant_cluster_cap)
        verdicts = R.acceptance(gated, a.accept_top_fraction_if_above)
        rest = kept.where("search_stage <> 'full_evaluated'").withColumns({"hard_filter_passed": F.lit(False), "accepted_before_top_fraction": F.lit(False), "accepted": F.lit(False), "hard_rejection_reasons": F.col("rejection_reasons"), "final_rejection_reasons": F.col("rejection_reasons")})
        return self._save(R.rank(verdicts.unionByName(rest, allowMissingColumns=True)), "candidate_registry")

    def _points(self, variant: tuple[str, str]) -> DataFrame | None:
        """The prepared matrix of a variant; None, with the reason kept, where it can't be made."""
        name = f"features/{variant[0]}_{variant[1]}"
        return self._table(name) if self._has(name) else self._save(self.features(self._table("rows"), *variant), name)

    def _finish(self, df: DataFrame, name: str) -> DataFrame:
        """Keep results: from here on their candidates are done."""
        wanted = {"rejection_reasons": "string", **{m: "double" for m in ("n_clusters", "silhouette", "davies_bouldin", "calinski_harabasz", "ari_seed", "nmi_seed", "mean_cluster_jaccard", "noise_fraction", "runtime_seconds", "pilot_score")}, "representative_seed": "int"}
        done = df.withColumns({k: F.lit(None).cast(t) for k, t in wanted.items() if k not in df.columns}).withColumn("finished_at", F.current_timestamp())
        return self._save(done, f"results/{name}")

    def _rejected(self, grid: list[dict], reasons: dict[str, str], stage: str, metrics: DataFrame | None = None) -> None:
        if grid:
            why = self.spark.createDataFrame([(g["candidate_id"], reasons[g["candidate_id"]]) for g in grid], "candidate_id string, rejection_reasons string")
            base = metrics.drop("rejection_reasons") if metrics is not None else search.registry(self.spark, grid)
            self._finish(base.join(why, "candidate_id").withColumn("search_stage", F.lit(stage)), f"{stage}_{T.stable_id(sorted(reasons))}")

    def _evaluate(self, grid: list[dict], judge=None) -> dict[str, str]:
        """Compatibility, pilot and full fits of candidates of one variant; judge names further pilot runs to stop, from (id, score) pairs.

        Returns the reasons of what was rejected."""
        c, why = self.config, {}
        variant = (grid[0]["transform"], grid[0]["encoding"])
        try:
            points = self._points(variant)
        except ValueError as e:
            why = {g["candidate_id"]: f"preprocessing_unavailable: {e}" for g in grid}
            self._rejected(grid, why, "compatibility_rejected")
            return why
        n, width = self._table("rows").count(), points.select(F.size("features")).first()[0]
        odd = self._incompatible(grid, n, width)
        self._rejected([g for g in grid if g["candidate_id"] in odd], odd, "compatibility_rejected")
        fit = [g for g in grid if g["candidate_id"] not in odd]
        why |= odd
        if not fit:
            return why
        name = T.stable_id(sorted(g["candidate_id"] for g in fit))
        # the pilot sees a sample of the rows; what fails there is not fitted in full
        pilot = points if n <= c.search.pilot_min_rows else S.take_exact(points, "row_idx", S.pilot_size(n, c.search.pilot_sample_fraction, c.search.pilot_min_rows), c.experiment.random_seed)
        tried, _ = self._measure(pilot, fit, c.search.seeds_pilot, f"pilot/{name}")
        tried = self._save(R.pilot_score(tried, c.evaluation.acceptance.weighted_score), f"pilot/{name}_scored")
        found = tried.select("candidate_id", R.prune_reasons(tried).alias("why"), "pilot_score").collect()
        bad = {r.candidate_id: r.why for r in found if r.why}
        for cid, reason in (judge([(r.candidate_id, r.pilot_score) for r in found]) if judge else {}).items():
            bad[cid] = ";".join(filter(None, [bad.get(cid, ""), reason]))
        self._rejected([g for g in fit if g["candidate_id"] in bad], bad, "pilot_pruned", tried)
        good = [g for g in fit if g["candidate_id"] not in bad]
        if good:
            out, runs = self._measure(points, good, c.search.seeds_full, f"labels/{name}")
            out = self._perturb(out, runs, variant, points, good)
            out = out.withColumns(X.penalties("n_clusters", n, width))
            self._finish(out.join(tried.select("candidate_id", "pilot_score"), "candidate_id", "left").withColumn("search_stage", F.lit("full_evaluated")), f"full_{name}")
        return why | bad

    def _incompatible(self, grid: list[dict], n: int, width: int) -> dict[str, str]:
        p = lambda k: F.get_json_object("clustering_params_json", f"$.{k}")
        t = search.registry(self.spark, grid).select("candidate_id", F.col(_CLUSTERER).alias("clusterer"), F.col(_METHOD).alias("representation"), p("linkage").alias("linkage"), F.coalesce(p("metric"), F.lit("euclidean")).alias("metric"), p("covariance_type").alias("covariance_type"), F.coalesce(p("n_clusters"), p("n_components")).cast("int").alias("k"), F.coalesce(p("latent_dim"), F.lit(10)).cast("int").alias("latent_dim"), F.lit(n).alias("n"), F.lit(width).alias("p"))
        return {r.candidate_id: r.why for r in t.select("candidate_id", R.compatibility_reasons().alias("why")).collect() if r.why}

    def _measure(self, points: DataFrame, grid: list[dict], seeds: list[int], name: str) -> tuple[DataFrame, DataFrame]:
        """A row per candidate with its metrics over all seeds, and the labels; both come from one job of fits, which is kept."""
        table = search.registry(self.spark, grid)
        fits = self._save(search.fit_table(points, table, seeds, quality=True), name)
        runs = fits.where("row_idx >= 0").drop("facts")
        out = table.join(search.seed_metrics(runs, search.fit_facts(fits)), "candidate_id").join(search.representative_seeds(runs, seeds), "candidate_id")
        if len(seeds) > 1:
            return out.join(search.stability(runs), "candidate_id", "left"), runs
        return out.withColumns({"ari_seed": F.lit(1.0), "nmi_seed": F.lit(1.0)}), runs

    def _perturb(self, out: DataFrame, runs: DataFrame, variant: tuple[str, str], points: DataFrame, grid: list[dict]) -> DataFrame:
        """out with the agreement of fits on drawn rows: the whole preprocessing is fitted on each draw again, or the matrix's rows are drawn."""
        c = self.config
        if not c.search.perturbations_full:
            return out.withColumns({"mean_cluster_jaccard": F.lit(1.0), "mean_cluster_jaccard_symmetric": F.lit(1.0)})
        table, seed, drawn, seconds = search.registry(self.spark, grid), c.experiment.random_seed, None, None
        name = T.stable_id(sorted(g["candidate_id"] for g in grid))
        for run in range(c.search.perturbations_full):
            draws = self._save(search.perturbation_draws(self._table("rows"), c.search.perturbation_type, seed, run), f"draws/{run}") if not self._has(f"draws/{run}") else self._table(f"draws/{run}")
            if c.search.stability_mode == "full_pipeline":
                made = f"drawn_features/{variant[0]}_{variant[1]}_{run}"
                if not self._has(made):
                    again = self._table("rows").join(draws, "row_idx").drop("row_idx").withColumnRenamed("draw_idx", "row_idx")
                    self._save(self.features(again, *variant), made)
                matrix = self._table(made)
            else:
                matrix = points.join(draws, "row_idx").select(F.col("draw_idx").alias("row_idx"), "features")
            fits = self._save(search.fit_table(matrix, table, [seed]), f"perturbed/{name}_{run}")
            part = fits.where("row_idx >= 0").select("candidate_id", F.lit(run).alias("run_id"), F.col("row_idx").alias("draw_idx"), "label").join(draws, "draw_idx")
            took = search.fit_facts(fits).select("candidate_id", F.col("facts")["runtime_seconds"].alias("s"))
            drawn, seconds = (part, took) if drawn is None else (drawn.unionByName(part), seconds.union(took))
        chosen = runs.join(out.select("candidate_id", F.col("representative_seed").alias("run_id")), ["candidate_id", "run_id"])
        agreement = search.perturbation_agreement(chosen, drawn)
        more = seconds.groupBy("candidate_id").agg(F.sum("s").alias("_more"))
        out = out.join(agreement, "candidate_id", "left").join(more, "candidate_id", "left")
        return out.withColumn("runtime_seconds", F.col("runtime_seconds") + F.coalesce("_more", F.lit(0.0))).drop("_more").fillna(0.0, ["mean_cluster_jaccard", "mean_cluster_jaccard_symmetric"])

    def _study(self, family: str, grid: list[dict]) -> None:
        """An ask/tell study over a family's candidates: batches are proposed, run, and their scores told; kept trials are not run again."""
        c = self.config
        axes = {"transform": [], "encoding": [], "representation": [], "clusterer": []}
        keys = lambda g: {"transform": g["transform"], "encoding": g["encoding"], "representation": json.dumps([g["representation"], g["representation_params"]], sort_keys=True), "clusterer": json.dumps(g["clusterer_params"], sort_keys=True)}
        pool = {}
        for g in grid:
            k = keys(g)
            pool[tuple(k.values())] = g
            for axis, value in k.items():
                axes[axis] += [value] if value not in axes[axis] else []
        pilots: list[float] = []
        trials: list[dict] = []

        def prune(scores: list[tuple[str, float]]) -> dict[str, str]:
            middle = float(np.median(pilots)) if len(pilots) >= 5 and c.search.optuna.pruner == "MedianPruner" else None
            pilots.extend(s for _, s in scores)
            return {cid: "optuna_pruned" for cid, s in scores if middle is not None and s < middle}

        def evaluate(batch: list[dict]) -> list[float | None]:
            chosen = [pool[tuple(p.values())] for p in batch]
            fresh = {g["candidate_id"]: g for g in chosen if g["candidate_id"] not in self._completed()}
            for variant in dict.fromkeys((g["transform"], g["encoding"]) for g in fresh.values()):
                self._evaluate([g for g in fresh.values() if (g["transform"], g["encoding"]) == variant], prune)
            kept = R.latest_per_candidate(self._kept("results"), "finished_at")
            got = {r.candidate_id: r for r in R.with_utilities(kept, c.evaluation.acceptance.weighted_score).select("candidate_id", "search_stage", "pilot_score", "final_weighted_score", "rejection_reasons").collect()}
            out = []
            for p, g in zip(batch, chosen, strict=True):
                r = got[g["candidate_id"]]
                state = {"full_evaluated": "completed", "pilot_pruned": "pruned"}.get(r.search_stage, "invalid")
                score = r.final_weighted_score if state == "completed" else r.pilot_score
                trials.append({"trial_number": len(trials), "candidate_id": g["candidate_id"], "family": family, "status": state, "pilot_score": r.pilot_score, "final_weighted_score": score, "reasons": r.rejection_reasons or "", "trial_params_json": json.dumps(p, sort_keys=True)})
                out.append(score if state == "completed" else None)
            return out

        search.ask_tell(axes, c.search.optuna.n_trials_per_family, evaluate, c.experiment.random_seed)
        if trials:
            names = list(trials[0])
            kinds = ["int", "string", "string", "string", "double", "double", "string", "string"]
            table = self.spark.createDataFrame([tuple(t.values()) for t in trials], ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))
            T.write_report(self._save(table, f"optuna/{family}_trials").orderBy("trial_number"), f"{self.folder}/optuna/{family}_trials.csv")
        best = max((t for t in trials if t["status"] == "completed" and t["final_weighted_score"] is not None), key=lambda t: t["final_weighted_score"], default=None)
        T.write_json({"family": family, "best_trial_number": best and best["trial_number"], "best_value": best and best["final_weighted_score"]}, f"{self.folder}/optuna/{family}_study_summary.json")

    # ------------------------------------------------------------------------------------- consensus and after

    def build_consensus(self) -> DataFrame:
        c = self.config.consensus
        reg = self._table("candidate_registry")
        used = reg.where("accepted") if c.include_only_accepted else reg.where("search_stage = 'full_evaluated'")
        accepted = R.run_weights(used, c.run_weighting.source, c.run_weighting.floor, c.run_weighting.normalize)
        chosen = accepted.select("candidate_id", "weight", "representative_seed", "n_clusters").orderBy("candidate_id").collect()
        if not chosen:
            raise RuntimeError("no candidate was accepted")
        first = self.spark.createDataFrame([(r.candidate_id, r.representative_seed) for r in chosen], "candidate_id string, run_id int")
        labels = self._kept("labels").where("row_idx >= 0")
        runs = self._save(labels.join(F.broadcast(first), ["candidate_id", "run_id"]).select(F.col("candidate_id").alias("run_id"), "row_idx", "label").distinct(), "consensus/runs")
        weights, method, most = [r.weight for r in chosen], c.consensus_method.split("_")[0], c.max_dense_n
        scores: dict[int, float] = {}
        if c.final_k_strategy == "data_driven":
            k, scores = C.data_driven_k(runs, weights, [round(r.n_clusters) for r in chosen], method, most)
        else:
            k = R.target_k(accepted).first().k
        placed = self._save(C.consensus_labels(runs, weights, k, method, most), "consensus/labels_by_position")
        u = c.uncertainty
        sure = self._save(C.uncertainty(runs, weights, placed, u.ambiguous_top2_gap_threshold, u.ambiguous_entropy_quantile), "consensus/uncertainty")
        self._save(C.cluster_summary(runs, weights, placed, sure), "consensus/cluster_summary")
        self._save(C.run_bootstrap(runs, weights, k, u.bootstrap_repeats, self.config.experiment.random_seed, method, most), "consensus/bootstrap_stability")
        self._save(X.membership(placed), "consensus/membership")
        ids = [x for x in self.config.data.ids() if x != "row_id"]
        out = self._save(self._table("rows").select("row_idx", "row_id", *ids).join(sure, "row_idx"), "consensus/labels")
        if c.coassociation_storage == "dense" or (c.coassociation_storage == "auto" and out.count() <= min(most, 2000)):
            self._save(C.coassociation(runs, weights), "consensus/coassociation")
        T.mark_stage(self.folder, "consensus", clusters=k, runs=len(chosen), silhouettes=scores)
        return out

    def feature_space(self) -> dict:
        """Which preprocessing the clusters are explained in, and why."""
        c = self.config.interpretation
        if c.feature_space == "original_imputed_scaled":
            return {"feature_space": c.feature_space, "continuous_transform": c.continuous_transform, "categorical_encoding": c.categorical_encoding, "source_candidate_id": None}
        accepted = self._table("candidate_registry").where("accepted")
        if c.feature_space == "best_candidate_preprocessing":
            r = R.rank(accepted).orderBy("rank").first()
            return {"feature_space": c.feature_space, "continuous_transform": r.continuous_transform, "categorical_encoding": r.categorical_encoding, "source_candidate_id": r.candidate_id}
        r = accepted.groupBy("continuous_transform", "categorical_encoding").count().orderBy(F.desc("count"), "continuous_transform", "categorical_encoding").first()
        return {"feature_space": c.feature_space, "continuous_transform": r.continuous_transform, "categorical_encoding": r.categorical_encoding, "source_candidate_id": None}

    def run_interpretation(self) -> DataFrame:
        c, roles, seed = self.config.interpretation, self.config.data.column_schema, self.config.experiment.random_seed
        space = self.feature_space()
        labels = self._table("consensus/labels").select("row_idx", F.col("consensus_label").alias("label"))
        rows = self._table("rows").join(labels.withColumnRenamed("label", "cluster"), "row_idx")
        others = [*roles.categorical, *roles.ordinal]
        profiles = self._save(E.profiles(rows, "cluster", roles.continuous, roles.binary, others), "interpretation/cluster_profiles")
        self._save(E.contrasts(rows, "cluster", roles.continuous, roles.binary, others), "interpretation/pairwise_cluster_contrasts")
        points, names = self.prepared(self._table("rows"), space["continuous_transform"], space["categorical_encoding"])
        data = self._save(points.join(labels, "row_idx"), "interpretation/data")
        model = {"kind": c.surrogate_model, "trees": 100}
        folds, cells = E.surrogate_cv(data, "row_idx", c.cross_validation_folds, c.repeated_cv_repeats, seed=seed, **model)
        self._save(folds, "interpretation/surrogate_cv_metrics")
        self._save(cells, "interpretation/surrogate_confusion_matrix")
        if c.use_permutation_importance:
            alone = {n: [i] for i, n in enumerate(names)}
            self._ranked(E.permutation_importance(data, "row_idx", alone, seed=seed, **model), "permutation_importance")
            self._ranked(E.heldout_importance(data, "row_idx", names, c.cross_validation_folds, c.repeated_cv_repeats, seed=seed, **model), "cv_permutation_importance")
            wide = data.select(*[F.col("features")[i].alias(n) for i, n in enumerate(names)])
            groups = Q.correlation_groups(wide, names, c.grouped_correlation_threshold) if len(names) > 1 else [names]
            together = {";".join(g): [names.index(n) for n in g] for g in groups}
            self._ranked(E.permutation_importance(data, "row_idx", together, seed=seed, **model), "grouped_permutation_importance")
        if c.use_shap:
            self._ranked(E.surrogate_shapley(data, names, seed=seed, **model).withColumnRenamed("mean_abs_shapley", "importance_mean"), "shap_summary")
            T.write_json({"status": "completed", "method": "Monte-Carlo Shapley values of the surrogate"}, f"{self.folder}/interpretation/shap_status.json")
        T.write_json(space, f"{self.folder}/interpretation/feature_space.json")
        T.mark_stage(self.folder, "interpretation", **space)
        return profiles

    def _ranked(self, df: DataFrame, name: str) -> None:
        """A table of importances, and its first rows."""
        kept = self._save(df, f"interpretation/{name}")
        self._save(kept.orderBy(F.desc("importance_mean"), "feature").limit(self.config.interpretation.top_n_features), f"interpretation/{name}_top_features")

    def importance(self) -> DataFrame | None:
        """The importance that reports show: the first of held-out, plain and Shapley that there is."""
        return next((self._table(f"interpretation/{n}") for n in ("cv_permutation_importance", "permutation_importance", "shap_summary") if self._has(f"interpretation/{n}")), None)

    def figure_data(self) -> dict[str, DataFrame]:
        """What pictures are drawn from, as tables: a layout of the rows with their clusters, cluster sizes and certainty, profiles, importances."""
        out = {}
        if self._has("consensus/labels"):
            certain = self._table("consensus/uncertainty")
            out["cluster_size_confidence"] = X.size_and_confidence(certain, self._table("consensus/cluster_summary"))
            sample = S.take_exact(self._table("interpretation/data").select("row_idx", "features", "label"), "row_idx", 2000, self.config.experiment.random_seed) if self._has("interpretation/data") else None
            if sample is not None:
                out["embedding"] = Q.pca(sample, 2).join(sample.select("row_idx", F.col("label").alias("consensus_label")), "row_idx").select("row_idx", F.col("scores")[0].alias("x"), F.get("scores", F.lit(1)).alias("y"), "consensus_label")
        if self._has("interpretation/cluster_profiles"):
            profiles = self._table("interpretation/cluster_profiles")
            out["profile_heatmap"] = X.profile_heatmap(profiles, [r.cluster for r in profiles.select("cluster").distinct().orderBy("cluster").collect()])
        if self.importance() is not None:
            out["feature_importance"] = self.importance().orderBy(F.desc("importance_mean"), "feature").limit(self.config.interpretation.top_n_features)
        return out

    def report(self) -> dict[str, DataFrame]:
        c, reg = self.config.reporting, self._table("candidate_registry")
        pick = lambda names: [n for n in names if n in reg.columns]
        out = {}
        if c.generate_tables:
            out = {"search_flow": R.search_flow(reg), "method_family_acceptance_summary": R.family_summary(reg)}
            out["quality_vs_stability"] = reg.dropna(subset=["silhouette", "ari_seed"]).select(*pick(["candidate_id", "family", "silhouette", "ari_seed", "accepted"]))
            out["accepted_candidate_heatmap"] = reg.where("accepted").select(*pick(["candidate_id", "family", "representation_name", "clustering_name", "silhouette", "davies_bouldin", "calinski_harabasz", "ari_seed", "nmi_seed", "mean_cluster_jaccard", "cluster_balance", "final_weighted_score"]))
        if c.generate_figures:
            out |= self.figure_data()
        out = {k: self._save(v, f"reports/{k}") for k, v in out.items()}
        for k, v in out.items():
            T.write_report(v, f"{self.folder}/reports/{k}.csv")
        T.mark_stage(self.folder, "report", tables=sorted(out))
        if c.manuscript_bundle:
            self.export_manuscript_bundle()
        return out

    def export_manuscript_bundle(self) -> str:
        """The tables of a run as single CSV files, its configuration, and how the clusters were made in words."""
        target, done = f"{self.folder}/manuscript_bundle", []
        for name in ("candidate_registry", *[f"reports/{n}" for n in ("search_flow", "method_family_acceptance_summary", "quality_vs_stability", "accepted_candidate_heatmap", "cluster_size_confidence", "profile_heatmap", "feature_importance", "embedding")], *[f"consensus/{n}" for n in ("cluster_summary", "bootstrap_stability")], *[f"interpretation/{n}" for n in ("cluster_profiles", "pairwise_cluster_contrasts", "surrogate_cv_metrics", "surrogate_confusion_matrix", "permutation_importance", "cv_permutation_importance", "grouped_permutation_importance", "shap_summary")]):
            if self._has(name):
                df = self._table(name)
                plain = df.select(*[F.to_json(x).alias(x) if t.startswith(("map", "array", "struct")) else F.col(x) for x, t in df.dtypes])
                T.write_report(plain, f"{target}/tables/{name.rsplit('/', 1)[-1]}.csv")
                done.append(name)
        c = self.config
        T.write_yaml(json.loads(c.model_dump_json()), f"{target}/config_snapshot.yaml")
        T.write_json({"tables": done, "stages": self.status()}, f"{target}/manifest.json")
        lines = [
            f"# {c.experiment.name}", "",
            f"Missing numbers: {c.data.missingness.continuous_imputer}. Transforms: {', '.join(c.preprocessing.continuous_transforms)}. Encodings: {', '.join(c.preprocessing.categorical_encoding)}.",
            f"Representations: {', '.join(m.name for m in c.representation.methods)}. Clusterers: {', '.join(m.name for m in c.clustering.methods)}. Candidates: {len(self._grid(None))}.",
            f"Seeds: {c.search.seeds_full}. Perturbations: {c.search.perturbations_full} ({c.search.perturbation_type}, {c.search.stability_mode}).",
            f"Score: {c.evaluation.acceptance.weighted_score}. Thresholds: {c.evaluation.acceptance.hard_thresholds}.",
            f"Consensus: {c.consensus.consensus_method}, number of clusters by {c.consensus.final_k_strategy}.",
        ]
        T.write_text("\n".join(lines) + "\n", f"{target}/methods.md")
        return target

    def run(self) -> DataFrame:
        """All stages that have no marker yet; a search without a marker goes on where it stopped."""
        reg = self._table("candidate_registry") if T.read_stage(self.folder, "search") else self.search()
        if reg.where("accepted").limit(1).count():
            if not T.read_stage(self.folder, "consensus"):
                self.build_consensus()
            if not T.read_stage(self.folder, "interpretation"):
                self.run_interpretation()
        self.report()
        return reg

    resume = run


def compare_runs(spark: SparkSession, folders: dict[str, str], base: str = "classical", other: str = "deep") -> DataFrame:
    """One row from the registries of two result folders: ratio of mean runtimes, and accepted candidates of each."""
    parts = [spark.read.parquet(f"{f}/candidate_registry.parquet").withColumn("family", F.lit(name)) for name, f in folders.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return X.family_comparison(R.family_summary(every), base, other)
