"""Declared schemas (DDL) of inputs and outputs."""

DRUG_ERA = "person_id bigint, ingredient_concept_id bigint, era_start_date date, era_end_date date, drug_exposure_count bigint, gap_days bigint"
DRUG_EXPOSURE = "person_id bigint, drug_concept_id bigint, drug_exposure_start_date date, drug_exposure_end_date date, days_supply int, quantity double"
OBSERVATION_PERIOD = "person_id bigint, observation_period_start_date date, observation_period_end_date date"
DEATH = "person_id bigint, death_date date"
CONCEPT = "concept_id bigint, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, standard_concept string, concept_code string"
CONCEPT_ANCESTOR = "ancestor_concept_id bigint, descendant_concept_id bigint, min_levels_of_separation int, max_levels_of_separation int"
INGREDIENT = "ingredient_concept_id bigint, concept_name string"

STATES = ("NoRx", "Initiation", "StableMono", "StableLowPoly", "StablePolypharmacy", "Intensifying", "Deintensifying", "HighTurnover", "ModerateFlux")
PHENOTYPES = (
    "Insufficient prescribing history",
    "High-turnover switching",
    "Intermittent stop-start",
    "Early drop-off / de-intensification",
    "Stable polypharmacy",
    "Persistent stable use",
    "Mixed transition pattern",
)
WINDOWS = (1, 2, 3, 4)
#: The feature vector, in order.
FEATURES = (
    "mean_active_n",
    "poly_month_prop",
    "mean_turnover",
    "burden_slope",
    "n_ingredient_eras",
    "n_distinct_ingredients",
    "early_disc_90_rate",
    "restart_180_rate",
    "switch_60_rate",
    "median_era_days",
    "is_single_era_maintenance",
    *(f"mean_burden_w{w}" for w in WINDOWS),
    *(f"prop_{s}" for s in STATES),
)
#: Without the flag of a single long era, as post-hoc tools use it.
FEATURES_LEGACY = tuple(f for f in FEATURES if f != "is_single_era_maintenance")
