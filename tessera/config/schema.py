"""Models of the experiment file. Unknown keys are errors everywhere; ids and targets can't be modelled."""

from __future__ import annotations

from pathlib import Path
from typing import Literal

from pydantic import BaseModel, ConfigDict, Field, model_validator

from tessera.functions.kernels import _OLD, CLUSTERERS
from tessera.sources.tables import read_yaml

TRANSFORMS = ("none", "standard", "robust", "power", "log1p_standard")
ENCODINGS = ("onehot", "ordinal")
REPRESENTATIONS = ("none", "pca", "umap", "autoencoder")


class Strict(BaseModel):
    model_config = ConfigDict(extra="forbid")


class Neighbours(Strict):
    n_neighbors: int = Field(5, ge=1)
    weights: Literal["uniform", "distance"] = "uniform"


class Rounds(Strict):
    max_iter: int = Field(10, ge=1)
    initial_strategy: Literal["mean", "median"] = "median"
    sample_posterior: bool = False
    random_state: int | None = None
    estimator: Literal["bayesian_ridge"] = "bayesian_ridge"


class Missingness(Strict):
    continuous_imputer: Literal["median", "knn", "iterative"] = "median"
    categorical_imputer: Literal["most_frequent"] = "most_frequent"
    add_missing_indicators: bool = True
    knn: Neighbours = Neighbours()
    iterative: Rounds = Rounds()


class ColumnSchema(Strict):
    continuous: list[str] = []
    binary: list[str] = []
    categorical: list[str] = []
    ordinal: list[str] = []

    def all(self) -> list[str]:
        return [*self.continuous, *self.binary, *self.categorical, *self.ordinal]

    @model_validator(mode="after")
    def disjoint(self):
        names = self.all()
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise ValueError(f"columns with more than one role: {twice}")
        return self


class Data(Strict):
    path: str
    id_column: str | None = None
    id_columns: list[str] = []
    target_columns: list[str] = []
    column_schema: ColumnSchema
    ordinal_maps: dict[str, list] = {}
    missingness: Missingness = Missingness()

    def ids(self) -> list[str]:
        return list(dict.fromkeys([*([self.id_column] if self.id_column else []), *self.id_columns]))

    @model_validator(mode="after")
    def no_leaks(self):
        modelled = set(self.column_schema.all())
        leaked = sorted(modelled & {*self.ids(), *self.target_columns})
        if leaked:
            raise ValueError(f"ids and targets can't be modelled: {leaked}")
        if set(self.ordinal_maps) != set(self.column_schema.ordinal):
            raise ValueError("every ordinal column needs a level list, and only those")
        for name, levels in self.ordinal_maps.items():
            if not levels or len(set(map(repr, levels))) != len(levels):
                raise ValueError(f"the levels of {name} must be given once each")
        return self


class Method(Strict):
    name: str
    params: dict = {}


class Methods(Strict):
    methods: list[Method] = [Method(name="none")]


class Clusterers(Strict):
    methods: list[Method] = Field(min_length=1)


class Study(Strict):
    enabled: bool = False
    sampler: str = "TPESampler"
    pruner: str = "MedianPruner"
    n_trials_per_family: int = Field(50, ge=0)


class Search(Strict):
    pilot_sample_fraction: float = Field(0.35, gt=0, le=1)
    pilot_min_rows: int = Field(250, ge=1)
    seeds_pilot: list[int] = [101, 102]
    seeds_full: list[int] = [101, 102, 103, 104, 105]
    perturbations_full: int = Field(5, ge=0)
    perturbation_type: Literal["bootstrap", "subsample"] = "bootstrap"
    stability_mode: Literal["full_pipeline", "processed_matrix"] = "full_pipeline"
    optuna: Study = Study()


class RareCategories(Strict):
    enabled: bool = False
    min_frequency: int | float = Field(0.01, gt=0)
    replacement: str = "__RARE__"


class Variance(Strict):
    enabled: bool = False
    threshold: float = 0.0


class Preprocessing(Strict):
    continuous_transforms: list[Literal[TRANSFORMS]] = ["standard"]
    categorical_encoding: list[Literal[ENCODINGS]] = ["onehot"]
    rare_category_collapse: RareCategories = RareCategories()
    variance_threshold: Variance = Variance()


class Structure(Strict):
    min_clusters: int = 2
    max_clusters: int = 10
    min_cluster_fraction: float = 0.03
    max_noise_fraction: float = 0.35
    dominant_cluster_cap: float = 0.85


class Acceptance(Strict):
    hard_thresholds: dict[str, float] = {}
    weighted_score: dict[str, float] = {}
    accept_top_fraction_if_above: float = 1.0


class Evaluation(Strict):
    internal_metrics: list[str] = []
    structure_constraints: Structure = Structure()
    acceptance: Acceptance = Acceptance()


class RunWeighting(Strict):
    source: str = "final_weighted_score"
    normalize: bool = True
    floor: float = 0.01


class Uncertainty(Strict):
    bootstrap_repeats: int = Field(25, ge=0)
    ambiguous_top2_gap_threshold: float = 0.10
    ambiguous_entropy_quantile: float = Field(0.90, ge=0, le=1)


class Consensus(Strict):
    include_only_accepted: bool = True
    run_weighting: RunWeighting = RunWeighting()
    consensus_method: Literal["hierarchical_on_coassociation", "spectral_on_coassociation"] = "hierarchical_on_coassociation"
    final_k_strategy: Literal["weighted_mode", "data_driven"] = "weighted_mode"
    coassociation_storage: Literal["auto", "dense", "sparse"] = "auto"
    max_dense_n: int = 10_000
    uncertainty: Uncertainty = Uncertainty()


class Interpretation(Strict):
    surrogate_model: Literal["xgboost", "random_forest"] = "xgboost"
    feature_space: Literal["original_imputed_scaled", "best_candidate_preprocessing", "consensus_majority_preprocessing"] = "original_imputed_scaled"
    continuous_transform: Literal[TRANSFORMS] = "standard"
    categorical_encoding: Literal[ENCODINGS] = "onehot"
    cross_validation_folds: int = Field(5, ge=2)
    repeated_cv_repeats: int = Field(3, ge=1)
    use_shap: bool = True
    use_permutation_importance: bool = True
    top_n_features: int = Field(30, ge=1)
    grouped_correlation_threshold: float = 0.85


class Reporting(Strict):
    generate_figures: bool = True
    generate_tables: bool = True
    manuscript_bundle: bool = True


class Experiment(Strict):
    name: str = "experiment"
    output_dir: str = "runs"
    random_seed: int = 2026
    n_jobs: int = -1
    use_ray: bool = False
    use_mlflow: bool = False
    use_gpu_if_available: bool = False
    deterministic_mode: Literal["strict", "fast"] = "fast"


class ExperimentConfig(Strict):
    """Keys that name other engines, devices or trackers (n_jobs, use_ray, use_mlflow, use_gpu_if_available) are read and change nothing."""

    experiment: Experiment = Experiment()
    data: Data
    search: Search = Search()
    preprocessing: Preprocessing = Preprocessing()
    representation: Methods = Methods()
    clustering: Clusterers
    evaluation: Evaluation = Evaluation()
    consensus: Consensus = Consensus()
    interpretation: Interpretation = Interpretation()
    reporting: Reporting = Reporting()

    @model_validator(mode="after")
    def known_methods(self):
        for kind, given, known in (("representation", self.representation.methods, REPRESENTATIONS), ("clusterer", self.clustering.methods, (*CLUSTERERS, *_OLD))):
            odd = sorted({m.name for m in given} - set(known))
            if odd:
                raise ValueError(f"unknown {kind}: {odd}")
        if "log1p_standard" in self.preprocessing.continuous_transforms and not self.data.column_schema.continuous:
            raise ValueError("log1p_standard needs a continuous column")
        return self


# What a file that leaves these out gets.
DEFAULTS = {
    "search": {"perturbation_type": "subsample"},
    "clustering": {"methods": [{"name": "kmeans", "params": {"n_clusters": [2, 3, 4]}}]},
    "evaluation": {
        "internal_metrics": ["silhouette", "davies_bouldin", "calinski_harabasz"],
        "acceptance": {
            "hard_thresholds": {"silhouette_min": -1.0, "ari_seed_min": 0.0, "nmi_seed_min": 0.0, "mean_cluster_jaccard_min": 0.0},
            "weighted_score": {"silhouette": 0.15, "davies_bouldin": 0.05, "calinski_harabasz": 0.05, "ari_seed": 0.3, "nmi_seed": 0.15, "mean_cluster_jaccard": 0.25, "cluster_balance": 0.05, "runtime": 0.03, "parsimony": 0.02},
        },
    },
}


def deep_merge(base: dict, over: dict) -> dict:
    """Mappings are merged, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load_config(path: str, defaults: dict | None = None) -> ExperimentConfig:
    """Read a YAML file over the defaults; its relative paths are relative to the file."""
    raw = deep_merge(DEFAULTS if defaults is None else defaults, read_yaml(path))
    here = Path(path).resolve().parent
    absolute = lambda p: p if "://" in p or Path(p).is_absolute() else str(here / p)
    config = ExperimentConfig.model_validate(raw)
    config.data.path = absolute(config.data.path)
    config.experiment.output_dir = absolute(config.experiment.output_dir)
    return config
