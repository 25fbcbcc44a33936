"""The profile: one small document that says what a reader is looking for.

It is held on the driver and compiled into literal expressions, so no plan
ever ships it as a table.  Its size is therefore bounded on construction
(:data:`MAX_TERMS`).  ``Profile.from_dict`` takes a document of the same shape
with somebody's own vocabulary.  The lists below are an example of our own; what
decides scores (weights, bonuses, penalties, the freshness curve) stands in
``fixed_values``.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from . import fixed_values as V

MAX_TERMS = 20_000


def _tiers() -> dict[int, list[str]]:
    return {
        24: ["munich", "münchen", "muenchen", "garching", "ingolstadt", "bavaria"],
        20: ["germany", "deutschland", "berlin", "hamburg", "stuttgart", "frankfurt",
             "köln", "cologne", "leipzig", "dresden", "karlsruhe", "aachen"],
        17: ["switzerland", "schweiz", "zurich", "zürich", "basel", "bern", "lausanne"],
        15: ["austria", "österreich", "vienna", "wien", "graz", "linz"],
        13: ["netherlands", "amsterdam", "eindhoven", "delft"],
        10: ["denmark", "copenhagen", "sweden", "stockholm", "dublin", "belgium"],
        7: ["france", "paris", "italy", "milan", "spain", "madrid", "lisbon", "portugal"],
        4: ["united kingdom", "london", "cambridge", "dubai"],
    }


def _countries() -> dict[str, list[str]]:
    return {
        "de": ["germany", "deutschland", "munich", "münchen", "berlin", "hamburg",
               "stuttgart", "köln", "leipzig", "bavaria", "garching"],
        "ch": ["switzerland", "schweiz", "zurich", "zürich", "basel", "bern"],
        "at": ["austria", "österreich", "vienna", "wien", "graz"],
        "nl": ["netherlands", "amsterdam", "eindhoven", "delft"],
        "eu": ["france", "paris", "italy", "milan", "spain", "portugal", "lisbon",
               "denmark", "sweden", "belgium"],
    }


def _exclude() -> list[str]:
    return ["india", "bangalore", "bengaluru", "hyderabad", "pune", "united states", "usa",
            "new york", "california", "texas", "china", "shanghai", "beijing", "japan",
            "tokyo", "singapore", "brazil", "mexico", "australia", "sydney", "canada",
            "toronto", "south africa", "egypt", "israel", "south korea", "seoul"]


def _skills() -> dict[str, list[str]]:
    return {
        "core_ml": ["pytorch", "scikit-learn", "deep learning", "machine learning",
                    "neural network", "neural networks", "transformer", "attention"],
        "research": ["graph neural", "graph neural network", "bayesian", "uncertainty",
                     "conformal prediction", "simulation", "digital twin"],
        "genai": ["llm", "rag", "embedding", "embeddings", "vector database",
                  "knowledge graph", "fine-tuning", "prompt engineering"],
        "vision": ["computer vision", "opencv", "object detection", "ocr"],
        "backend": ["fastapi", "python", "sql", "postgresql", "redis", "microservices"],
        "mlops": ["docker", "ci/cd", "mlflow", "kafka", "mlops"],
        "data": ["pandas", "numpy", "data pipeline", "time series", "forecasting",
                 "feature engineering"],
    }


def _domains() -> list[str]:
    """Industries by the words that name them in a posting."""
    return ["railway", "logistics", "shipping", "agriculture", "food", "retail", "banking", "reinsurance", "telecommunications", "chemicals",
            "mining", "steel", "construction", "water", "wind power", "photovoltaics", "hospital", "diagnostics", "laboratory", "robotics",
            "automotive", "satellites", "gaming", "publishing", "education", "public sector"]


def _categories() -> dict[str, list[str]]:
    """Kinds of work by the phrases that mark them; the longest phrase goes first."""
    return {
        "Modelling": ["machine learning", "statistical modelling", "predictive model"],
        "Seeing": ["image recognition", "video analytics", "point cloud"],
        "Text": ["text mining", "question answering", "information retrieval"],
        "Data Platform": ["data warehouse", "data lake", "data engineer", "stream processing"],
        "Analysis": ["data scientist", "data analyst", "experiment design"],
        "Operations": ["site reliability", "platform engineer", "release automation"],
        "Science": ["research scientist", "numerical simulation", "bioinformatics"],
        "Machines": ["robotics", "control engineer", "embedded software"],
    }


def _flags() -> list[dict]:
    """Phrases a reader wants to be warned of."""
    return [
        {"code": "PASSPORT", "penalty": 18, "explain": "Open to some nationalities only",
         "phrases": ["citizenship required", "citizens only", "nationals only"]},
        {"code": "PERMIT", "penalty": 16, "explain": "Expects a work permit that is there already",
         "phrases": ["no sponsorship", "existing work permit", "visa is not possible"]},
        {"code": "ROTA", "penalty": 9, "explain": "Work at night or on call",
         "phrases": ["night shift", "on-call rota", "weekend duty"]},
        {"code": "TRAVEL", "penalty": 6, "explain": "A large share of travel",
         "phrases": ["extensive travel", "travel up to 80", "travel up to 100"]},
    ]


def _families() -> list[dict]:
    """Groups of neighbouring skills; ``transfer`` is the credit for holding another member."""
    return [
        {"family": "tensor frameworks", "transfer": 0.75, "why": "models are built from the same layers and losses",
         "members": ["pytorch", "tensorflow", "mxnet", "paddlepaddle"]},
        {"family": "estimators on tables", "transfer": 0.7, "why": "fitting and validation follow one pattern",
         "members": ["scikit-learn", "weka", "h2o", "statsmodels"]},
        {"family": "arrays", "transfer": 0.7, "why": "computation on whole arrays",
         "members": ["numpy", "cupy", "xarray"]},
        {"family": "data frames", "transfer": 0.8, "why": "select, group and join on columns",
         "members": ["pandas", "polars", "dplyr"]},
        {"family": "image libraries", "transfer": 0.7, "why": "filters and geometry of images",
         "members": ["opencv", "scikit-image", "pillow", "halcon"]},
        {"family": "retrieval for language models", "transfer": 0.65, "why": "find text, then let a model answer",
         "members": ["rag", "langchain", "llamaindex", "haystack"]},
        {"family": "text search", "transfer": 0.6, "why": "inverted indexes and ranking",
         "members": ["elasticsearch", "opensearch", "solr", "vector database"]},
        {"family": "graph stores", "transfer": 0.55, "why": "nodes, edges and paths",
         "members": ["knowledge graph", "neo4j", "sparql"]},
        {"family": "sql dialects", "transfer": 0.85, "why": "the language differs in details",
         "members": ["sql", "postgresql", "mariadb", "oracle database", "sql server"]},
        {"family": "key-value stores", "transfer": 0.6, "why": "caching and expiry",
         "members": ["redis", "memcached", "dynamodb"]},
        {"family": "message brokers", "transfer": 0.65, "why": "topics, offsets and retries",
         "members": ["kafka", "nats", "activemq"]},
        {"family": "http services", "transfer": 0.75, "why": "routes, validation and tests",
         "members": ["fastapi", "starlette", "express", "spring boot"]},
        {"family": "container images", "transfer": 0.85, "why": "the same image format",
         "members": ["docker", "buildah"]},
        {"family": "build servers", "transfer": 0.7, "why": "stages that run on every change",
         "members": ["ci/cd", "jenkins", "gitlab ci", "github actions"]},
        {"family": "experiment records", "transfer": 0.75, "why": "runs with parameters and results",
         "members": ["mlflow", "neptune", "tensorboard"]},
        {"family": "forecasting", "transfer": 0.6, "why": "trend, season and error",
         "members": ["time series", "forecasting", "prophet"]},
    ]


@dataclass(frozen=True)
class Profile:
    # thresholds
    max_age_days: int = 14
    archive_after_days: int = 30
    min_score: int = 25
    recommend_min_score: int = 60
    high_match_score: int = 80
    draft_min_score: int = 60
    keep_undated: bool = True
    target_salary_eur: int = 70_000
    max_enrich: int = 120
    follow_up_after_days: int = 7
    failures_before_backoff: int = 3
    backoff_minutes: int = 180
    rate_limited_minutes: int = 30
    years_experience: float = 1.5
    education_level: str = "msc"
    name: str = "A. Reader"
    email: str = "reader@example.com"
    available_from: str = "immediately"
    # vocabularies; declaration order is meaning (first hit wins)
    location_tiers: dict = field(default_factory=_tiers)
    country_terms: dict = field(default_factory=_countries)
    location_exclude: list = field(default_factory=_exclude)
    role_include: list = field(default_factory=lambda: [
        "machine learning", "data scientist", "data engineer", "research scientist",
        "algorithm engineer", "perception engineer", "robotics engineer"])
    # a trailing * marks a prefix match, everything else is a whole term
    not_fulltime: list = field(default_factory=lambda: [
        "intern", "internship", "praktik*", "werkstudent*", "working student", "thesis",
        "masterarbeit", "bachelorarbeit", "ausbildung", "apprentice*", "volunteer",
        "part-time", "teilzeit", "phd", "doctoral", "doktorand*", "freelance", "contractor"])
    skills: dict = field(default_factory=_skills)
    domains: list = field(default_factory=_domains)
    role_categories: dict = field(default_factory=_categories)
    preferred_industries: list = field(default_factory=lambda: [
        "railway", "robotics", "hospital", "wind power"])
    flags: list = field(default_factory=_flags)
    families: list = field(default_factory=_families)
    # score configuration
    weights: dict = field(default_factory=lambda: dict(V.SCORE_WEIGHTS))
    tier_bonus: dict = field(default_factory=lambda: dict(V.TIER_BONUS))
    seniority_penalty: dict = field(default_factory=lambda: dict(V.SENIORITY_PENALTY))
    location_penalty: dict = field(default_factory=lambda: dict(V.LOCATION_PENALTY))
    language_penalty: dict = field(default_factory=lambda: dict(V.LANGUAGE_PENALTY))
    freshness_curve: list = field(default_factory=lambda: [list(p) for p in V.FRESHNESS_CURVE])

    def __post_init__(self) -> None:
        if not 0 <= self.min_score <= self.recommend_min_score <= self.high_match_score <= 100:
            raise ValueError("thresholds must satisfy 0 <= min <= recommend <= high <= 100")
        if abs(sum(self.weights.values()) - 1.0) > 1e-6:
            raise ValueError("weights must add up to 1")
        if self.max_age_days < 1 or self.archive_after_days < 1:
            raise ValueError("day windows must be positive")
        if self.term_count() > MAX_TERMS:
            raise ValueError(f"profile holds more than {MAX_TERMS} terms")

    def term_count(self) -> int:
        nested = [self.location_tiers, self.country_terms, self.skills, self.role_categories]
        flat = [self.location_exclude, self.role_include, self.not_fulltime, self.domains]
        return (sum(len(t) for d in nested for t in d.values()) + sum(map(len, flat))
                + sum(len(f["members"]) for f in self.families))

    def skill_terms(self) -> list[str]:
        return list(dict.fromkeys(t for ts in self.skills.values() for t in ts))

    def changed(self, **kw) -> "Profile":
        return replace(self, **kw)

    @classmethod
    def from_dict(cls, doc: dict) -> "Profile":
        known = {f.name for f in fields(cls)}
        unknown = set(doc) - known
        if unknown:
            raise ValueError(f"unknown profile keys: {sorted(unknown)}")
        doc = dict(doc)
        if "location_tiers" in doc:
            doc["location_tiers"] = {int(k): v for k, v in doc["location_tiers"].items()}
        return cls(**doc)


DEFAULT = Profile()
