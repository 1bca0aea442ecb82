import datetime as dt
import gzip

import pytest

from dosepath import config
from dosepath.config import Settings
from dosepath.plans import external, trajectory
from dosepath.sources import omop, rawmodel, registers

D = dt.date.fromisoformat


@pytest.fixture
def folder(tmp_path):
    files = {
        "drug_era.csv": "eid,ingredient_concept_id,drug_era_start_date,drug_era_end_date,drug_exposure_count,gap_days\n1,10,2020-01-01,2021-06-30,3,0\n1,10,bad,2020-01-02,1,0\n2,10,2020-02-01,2020-01-01,1,0\n",
        "drug_exposure.csv": "person_id,drug_concept_id,drug_exposure_start_date,drug_exposure_end_date,days_supply,quantity\n1,11,2020-01-01,,200,1\n1,11,2020-08-01,,200,1\n",
        "observation_period.csv": "person_id,observation_period_start_date,observation_period_end_date\n1,2018-01-01,2023-01-01\n2,2018-01-01,2023-01-01\n",
        "concept.csv": "concept_id\tconcept_name\tdomain_id\tvocabulary_id\tconcept_class_id\tstandard_concept\tconcept_code\n10\tA\tDrug\tV\tIngredient\tS\t1\n11\tA 5 mg\tDrug\tV\tClinical Drug\tS\t2\n",
        "concept_ancestor.csv": "ancestor_concept_id,descendant_concept_id,min_levels_of_separation,max_levels_of_separation\n10,11,1,1\n10,10,0,0\n11,11,0,0\n",
        "death.csv.gz": "person_id,death_date\n1,2022-05-01\n1,2022-04-01\n",
    }
    for name, text in files.items():
        if name.endswith(".gz"):
            with gzip.open(tmp_path / name, "wt") as f:
                f.write(text)
        else:
            (tmp_path / name).write_text(text)
    return tmp_path


def raw(folder):
    return {"paths": {"omop_dir": str(folder)}, "files": {"death": "death.csv.gz"}, "csv": {"concept_sep": "\t", "concept_ancestor_sep": ","}}


def test_standardised_tables(spark, folder):
    t = omop.standardised(omop.load_tables(spark, raw(folder)))
    assert [(r.person_id, r.era_start_date) for r in t["drug_era"].collect()] == [(1, D("2020-01-01"))]
    assert [tuple(r) for r in t["death"].collect()] == [(1, D("2022-04-01"))]
    assert [tuple(r) for r in t["ingredients"].collect()] == [(10, "A")]


def test_death_is_optional(spark, folder):
    t = omop.load_tables(spark, raw(folder) | {"files": {"death": "none.csv"}})
    assert t["death"] is None and not t["have_death"]


def test_whole_run_with_sensitivity(spark, folder, tmp_path):
    t = omop.standardised(omop.load_tables(spark, raw(folder)))
    out = trajectory.run_omop(t, Settings(k_grid=(2,)), sensitivity=True, out=str(tmp_path / "out"))
    (r,) = out["comparison"].collect()
    assert r.pid == 1 and r.same_phenotype in (0, 1)
    assert spark.read.parquet(f"{tmp_path}/out/primary_vs_exposure_sensitivity.parquet").count() == 1


def test_external_folder_falls_back_to_exposures(spark, folder):
    assert omop.find_table(spark, str(folder), "drug_era", "csv").endswith("drug_era.csv")
    (folder / "drug_era.csv").unlink()
    (r,) = omop.external_eras(spark, str(folder), gap_days=400).collect()
    assert (r.ingredient_concept_id, r.drug_exposure_count, r.gap_days) == (11, 2, 0)
    (folder / "drug_exposure.csv").unlink()
    with pytest.raises(FileNotFoundError):
        omop.external_eras(spark, str(folder))


def test_external_eras_need_columns_and_have_defaults(spark, tmp_path):
    (tmp_path / "DRUG_ERA.csv").write_text("PERSON_ID,drug_concept_id,drug_era_start_date,drug_era_end_date\n1,5,2020-01-01,2020-02-01\n")
    (r,) = omop.external_eras(spark, str(tmp_path)).collect()
    assert (r.ingredient_concept_id, r.drug_exposure_count, r.gap_days) == (5, 1, 0)
    (tmp_path / "DRUG_ERA.csv").write_text("person_id,drug_concept_id\n1,5\n")
    with pytest.raises(ValueError, match="drug_era_end_date"):
        omop.external_eras(spark, str(tmp_path))


def test_external_eras_carry_their_description(spark, tmp_path):
    (tmp_path / "drug_era.csv").write_text("person_id,drug_concept_id,drug_era_start_date,drug_era_end_date,archetype\n1,5,2020-01-01,2020-02-01,acute_antibiotic\n2,5,2020-01-01,2020-02-01,\n")
    rows = {r.person_id: r for r in omop.external_eras(spark, str(tmp_path)).collect()}
    assert [rows[p].archetype for p in (1, 2)] == ["acute_antibiotic", "external_omop"]
    assert rows[1].ingredient_name is None and rows[1].atc_group is None


def test_external_observation_and_persons(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="observation_period"):
        omop.external_observation(spark, str(tmp_path))
    assert omop.external_persons(spark, str(tmp_path)) is None
    (tmp_path / "Observation_Period.csv").write_text("person_id,observation_period_start_date\n1,2018-01-01\n")
    with pytest.raises(ValueError, match="observation_period_end_date"):
        omop.external_observation(spark, str(tmp_path))
    (tmp_path / "Observation_Period.csv").write_text("PERSON_ID,observation_period_start_date,observation_period_end_date,x\n1,2018-01-01,2023-01-01,\n2,bad,2023-01-01,\n")
    assert [tuple(r) for r in omop.external_observation(spark, str(tmp_path)).collect()] == [(1, D("2018-01-01"), D("2023-01-01"))]
    (tmp_path / "person.csv").write_text("person_id\n7\n")
    assert [tuple(r) for r in omop.external_persons(spark, str(tmp_path)).collect()] == [(7, 1970, 0)]


def test_external_folder_is_exported_and_run(spark, folder, tmp_path):
    out = str(tmp_path / "external")
    eras = folder / "drug_era.csv"
    eras.write_text(eras.read_text().replace("eid", "person_id"))
    paths = external.export(spark, str(folder), out)
    assert sorted(paths) == ["drug_era", "observation_period"]
    again = omop.external_eras(spark, out, fmt="parquet")
    assert sorted(map(str, again.collect())) == sorted(map(str, omop.external_eras(spark, str(folder)).collect()))
    path = config.save(external.configuration("x", out, Settings(k_grid=(2,))), tmp_path / "config" / "x.yaml")
    raw = config.load(path)
    assert raw["paths"]["omop_dir"] == out
    found = external.run(spark, out, config.settings_of(raw), fixed_k=2)
    assert found["eligible"].count() == found["final_person"].count()


def test_vocabulary_may_be_absent(spark, folder):
    assert omop.vocabulary(spark, f"{folder}/concept.csv", sep="\t").count() == 2
    assert omop.vocabulary(spark, f"{folder}/nothing.csv").columns == ["ingredient_concept_id", "concept_name"]


def test_registers(spark, tmp_path):
    (tmp_path / "lmdb.csv").write_text("PNR,EKSD,ATC,PACKSIZE,APK,INDO,VOLUME\na,2020-01-01,N06AB06,1,1,1,30\na,2020-02-10,N06AB06,1,1,1,\na,2020-01-01,N06AB06,1,1,1,0.5\nb,2020-01-01,N05,1,1,1,30\nc,2020-01-01,C01AA05,1,1,1,9\n")
    eras = registers.register_eras(spark, f"{tmp_path}/lmdb.csv", atc_prefixes=["N06", "N05"]).collect()
    by = {r.ingredient_concept_id: r for r in eras}
    assert set(by) == {1098249302651921640, -1}
    assert by[1098249302651921640].era_end_date == D("2020-03-10") and by[1098249302651921640].drug_exposure_count == 2
    (tmp_path / "cpr.csv").write_text("pnr,foed_dato,haend_dato,haend_kode\na,1980-01-01,,\nb,2000-05-05,2019-01-01,u\nc,1980-01-01,,\n")
    (tmp_path / "dod.csv").write_text("pnr,dod_dato\na,2010-01-01\na,2009-01-01\nc,1990-01-01\n")
    observed, death, have = registers.register_observation(spark, f"{tmp_path}/cpr.csv", f"{tmp_path}/dod.csv")
    assert sorted((str(r[1]), str(r[2])) for r in observed.collect()) == [("1998-01-01", "2009-01-01"), ("2018-05-05", "2019-01-01")]
    assert have and death.count() == 2


def test_british_dates_on_request(spark):
    from pyspark.sql import functions as F

    from dosepath.functions.columns import lenient_date

    df = spark.createDataFrame([("31/12/2020",), ("2020-12-31",), ("x",)], "d string")
    assert [r[0] for r in df.select(lenient_date(F.col("d"), british=True)).collect()] == [D("2020-12-31"), D("2020-12-31"), None]
    assert [r[0] for r in df.select(lenient_date(F.col("d"))).collect()] == [None, D("2020-12-31"), None]


def test_configuration_names_every_missing_key():
    with pytest.raises(ValueError, match=r"paths.omop_dir, analysis.followup_months"):
        config.settings_of({"project": {"output_dir": "o"}, "paths": {}, "analysis": {"washout_days": 1, "maintenance_min_total_days": 2}, "clustering": {"k_grid": [2], "seed": 1}})
    s = config.settings_of({"project": {"output_dir": "o"}, "paths": {"omop_dir": "x"}, "analysis": {"washout_days": 1, "followup_months": 12, "maintenance_min_total_days": 2}, "clustering": {"k_grid": [2, 3], "seed": 1, "final_k": 3}, "phenotype": {"switch_high": 0.7}})
    assert (s.washout_days, s.followup_months, s.k_grid, s.final_k, s.switch_high) == (1, 12, (2, 3), 3, 0.7)


def test_raw_model_files_are_read_again(spark, tmp_path):
    paths = rawmodel.write(spark, str(tmp_path / "raw"), 300, seed=3)
    assert sorted(p.name for p in (tmp_path / "raw").iterdir() if not p.name.endswith(".crc")) == sorted(rawmodel.FILES.values())
    made = rawmodel.tables(spark, 300, seed=3)
    for name, path in paths.items():
        with (gzip.open if path.endswith(".gz") else open)(path, "rt") as f:
            lines = f.read().splitlines()
        assert lines[0] == ",".join(made[name].columns) and len(lines) - 1 == made[name].count()
        back = spark.read.schema(made[name].schema).option("header", True).csv(path)
        assert sorted(map(str, back.collect())) == sorted(map(str, made[name].collect()))
    raw = rawmodel.configuration(str(tmp_path / "raw"))
    t = omop.standardised(omop.load_tables(spark, raw))
    assert t["have_death"] and t["ingredients"].count() == 10 and t["drug_era"].count() == made["drug_era"].count()
    assert made["drug_era"].select("drug_era_id").distinct().count() == made["drug_era"].count()
    assert made["drug_exposure"].select("drug_exposure_id").distinct().count() == made["drug_exposure"].count()
    # exposures lie in observation, and the eras are those of the exposures
    inside = made["drug_exposure"].join(made["observation_period"], "person_id").where("drug_exposure_start_date < observation_period_start_date or drug_exposure_end_date > observation_period_end_date")
    assert inside.count() == 0
    found = trajectory.run_omop(t, Settings(k_grid=(2,)), sensitivity=True)
    assert found["comparison"].where("same_phenotype = 0").count() == 0 < found["comparison"].count()


def test_named_csv_replaces_what_is_there_and_leaves_nothing_beside(spark, tmp_path):
    from dosepath.plans import sinks

    path = str(tmp_path / "t.csv.gz")
    df = spark.range(5000).selectExpr("id", "concat('a,\"', id, '\"') as s", "cast(null as string) as n").repartition(7)
    for rows in (df, df.limit(10), df.limit(0)):
        assert sinks.write_named_csv(rows, path) == path
        with gzip.open(path, "rt") as f:
            lines = f.read().splitlines()
        assert lines[0] == "id,s,n" and len(lines) == rows.count() + 1
        back = spark.read.schema(df.schema).option("header", True).option("escape", "\\").csv(path)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["t.csv.gz"]


def test_stub_vocabulary(spark, tmp_path):
    paths = rawmodel.write_stub_vocabulary(spark, str(tmp_path))
    t = {k: omop.read_table(spark, v) for k, v in paths.items()}
    assert t["concept"].count() == t["concept_ancestor"].count() == 9
    assert t["concept"].where("concept_code = concat('SYN_', concept_id) and invalid_reason is null").count() == 9


def test_external_run_takes_deaths_and_controls(spark, tmp_path):
    (tmp_path / "Drug_Era.csv").write_text("person_id,ingredient_concept_id,drug_era_start_date,drug_era_end_date,archetype\n1,10,2020-01-01,2021-06-30,acute_antibiotic\n2,10,2020-01-01,2020-01-09,acute_antibiotic\n3,10,2020-01-01,2021-06-30,\n4,10,2020-01-01,2021-06-30,other\n")
    (tmp_path / "observation_period.csv").write_text("person_id,observation_period_start_date,observation_period_end_date\n" + "".join(f"{p},2018-01-01,2023-01-01\n" for p in (1, 2, 3, 4)))
    (tmp_path / "death.csv").write_text("person_id,death_date\n3,2020-05-01\n3,2020-03-01\n4,bad\n")
    s = Settings(k_grid=(2,))
    found = external.run(spark, str(tmp_path), s, fmt="csv", controls=["acute_antibiotic"], fixed_k=2)
    assert found["negative_controls"] == {"passed": False, "n_violations": 1, "violations": [1]}
    assert {r.person_id: r.censor_date for r in found["eligible"].collect()}[3] == D("2020-03-01")
    none = external.run(spark, str(tmp_path), s, fmt="csv", deaths=False, controls=["no such"], fixed_k=2)
    assert none["negative_controls"]["passed"] and {r.person_id: r.censor_date for r in none["eligible"].collect()}[3] > D("2020-03-01")
    out = str(tmp_path / "out")
    assert sorted(external.export(spark, str(tmp_path), out, deaths=True)) == ["death", "drug_era", "observation_period"]
    assert [tuple(r) for r in omop.external_deaths(spark, out, fmt="parquet").collect()] == [(3, D("2020-03-01"))]
    assert external.configuration("x", out, s, deaths=True)["files"]["death"] == "death.parquet"
