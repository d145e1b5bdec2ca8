import pytest
from pyspark.sql import functions as F

from cropline import schemas
from cropline.plans.alignment import refresh_partition, refresh_state
from cropline.plans.driver_queries import _write_years
from cropline.sources import files as S


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


AGRI = "State,District,Year,Season,Crop,Area,Production,SUBDIVISION,Rainfall,Modal_Price,Min_Price,Max_Price"


def test_facts_by_name(spark, tmp_path):
    path = write(tmp_path / "agri.csv", AGRI + ",Note", 'BIHAR,"D, E",2003,Rabi  ,Rice,2,8,X,0.5,100,-1,1,hi')
    df = S.read_agri(spark, path)
    assert df.schema == schemas.AGRI
    assert tuple(df.first()) == ("BIHAR", "D, E", 2003, "Rabi  ", "Rice", 2.0, 8.0, "X", 0.5, 100.0, -1.0, 1.0)
    assert dict(S.read_agri(spark, path, raw=True).dtypes)["Area"] == "string"


def test_missing_column_fails(spark, tmp_path):
    path = write(tmp_path / "agri.csv", "State,District", "A,B")
    with pytest.raises(Exception, match="Year"):
        S.read_agri(spark, path)


@pytest.fixture
def price_folder(tmp_path):
    head = "State,District,Commodity,Min_Price,Max_Price,Modal_Price"
    write(tmp_path / "p" / "2003.csv", head, "Assam,d,Paddy,1000,2000,1500", "Bihar,d,Paddy,NA,2000,1500")
    write(tmp_path / "p" / "2004.extra.csv", head, "Assam,d,Paddy,1100,,1600")
    return str(tmp_path / "p")


def test_year_comes_from_the_file_name(spark, price_folder):
    rows = {(r.State, r.Year): (r.Min_Price, r.Max_Price) for r in S.read_prices(spark, price_folder).collect()}
    assert rows == {("Assam", 2003): (1000.0, 2000.0), ("Bihar", 2003): (None, 2000.0), ("Assam", 2004): (1100.0, None)}


def test_only_wanted_columns(spark, price_folder):
    assert S.read_prices(spark, price_folder, ["State", "Year"]).columns == ["State", "Year"]


def test_columns_are_found_by_name(spark, price_folder, tmp_path):
    write(tmp_path / "p" / "2005.csv", "Modal_Price,Note,District,State,Commodity,Market,Min_Price", "3,x,d,Assam,Paddy,m,1")
    rows = {r.Year: r for r in S.read_prices(spark, price_folder).filter("State = 'Assam'").collect()}
    assert (rows[2005].Min_Price, rows[2005].Max_Price, rows[2005].Modal_Price, rows[2005].Market) == (1.0, None, 3.0, "m")
    assert rows[2003].Market is None and rows[2003].Modal_Price == 1500.0


def test_no_files_give_an_empty_typed_table(spark, tmp_path):
    df = S.read_prices(spark, str(tmp_path / "none" / "*.csv"))
    assert df.count() == 0 and dict(df.dtypes)["Year"] == "int" and df.columns[:3] == ["State", "District", "Market"]


def test_rainfall_of_one_subdivision(spark, tmp_path):
    head = ",".join(schemas.RAINFALL.names)
    values = ",".join(["1"] * 15 + ["NA", "3"])
    path = write(tmp_path / "rain.csv", head, f" Assam & Meghalaya ,2003,{values}", f"Bihar,2003,{values}")
    rows = S.read_rainfall(spark, path, "ASSAM & MEGHALAYA").collect()
    assert len(rows) == 1 and rows[0].YEAR == 2003 and rows[0].JJAS is None and rows[0].OND == 3.0


def test_production_of_one_state(spark, tmp_path):
    head = ",".join(schemas.PRODUCTION.names)
    path = write(tmp_path / "prod.csv", head, " assam,d,2003,Kharif,Rice,2,8", "Bihar,d,2003,Kharif,Rice,2,")
    assert S.read_production(spark, path).count() == 2
    assert S.read_production(spark, path, "ASSAM").count() == 1


def test_columns_are_found_by_pattern(frame):
    df = frame("state_name string, DISTRICT string, Crop string, commodity string, Min_x double, modal double", [])
    found = S.discover_columns(df)
    assert found["commodity"] == ["Crop", "commodity"] and found["district"] == ["DISTRICT"] and found["max"] == []


@pytest.mark.parametrize("file_format", ["csv", "parquet"])
def test_refresh_publishes_a_new_version(spark, frame, tmp_path, price_folder, file_format):
    path = write(tmp_path / "agri.csv", AGRI, "ASSAM,OLD,2003,Rabi,Rice,2,8,X,0.5,100,-1,1", "BIHAR,D,2003,Rabi,Rice,2,8,X,0.5,100,-1,1")
    production = write(tmp_path / "prod.csv", ",".join(schemas.PRODUCTION.names), "Assam,new,2003,Kharif,Rice,2,8")
    rain = write(tmp_path / "rain.csv", ",".join(schemas.RAINFALL.names), "Assam & Meghalaya,2003," + ",".join(["100"] * 17))
    root = str(tmp_path / "published")
    target = refresh_state(
        S.read_agri(spark, path), S.read_production(spark, production), S.read_prices(spark, price_folder),
        S.read_rainfall(spark, rain), "ASSAM", "ASSAM & MEGHALAYA", root, "2", file_format=file_format,
    )
    assert target == f"{root}/version=2"
    df = S.read_agri(spark, target) if file_format == "csv" else spark.read.parquet(target)
    assert {(r.State, r.District, r.Modal_Price) for r in df.collect()} == {("BIHAR", "D", 100.0), ("ASSAM", "NEW", 1500.0)}


def test_refresh_leaves_other_states_alone(spark, tmp_path, price_folder):
    path = write(tmp_path / "agri.csv", AGRI, "Assam,OLD,2003,Rabi,Rice,2,8,X,0.5,100,-1,1", "BIHAR,D,2003,Rabi,Rice,2,8,X,0.5,100,-1,1",
                 ",D,2003,Rabi,Rice,2,8,X,0.5,100,-1,1")
    production = write(tmp_path / "prod.csv", ",".join(schemas.PRODUCTION.names), "Assam,new,2003,Kharif,Rice,2,8")
    rain = write(tmp_path / "rain.csv", ",".join(schemas.RAINFALL.names), "Assam & Meghalaya,2003," + ",".join(["100"] * 17))
    root = S.publish_states(S.read_agri(spark, path), str(tmp_path / "states"))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "states").rglob("*.parquet")}
    args = S.read_prices(spark, price_folder), S.read_rainfall(spark, rain), "ASSAM", "ASSAM & MEGHALAYA"
    refresh_partition(root, S.read_production(spark, production), *args)
    after = {f: f.stat().st_mtime_ns for f in (tmp_path / "states").rglob("*.parquet")}
    # No file is changed or removed, and only the state has new ones.
    assert all(after.get(f) == before[f] for f in before)
    assert {f.parent.name for f in set(after) - set(before)} == {"state_key=ASSAM"}
    rows = {(r.State, r.District) for r in S.read_states(spark, root).collect()}
    assert rows == {("BIHAR", "D"), (None, "D"), ("ASSAM", "NEW")}


def test_prices_by_year_are_pruned(spark, price_folder, tmp_path, capsys):
    path = S.publish_prices(S.read_prices(spark, price_folder), str(tmp_path / "by_year"))
    df = S.read_published_prices(spark, path).filter("Year = 2004")
    df.explain()
    assert "PartitionFilters: [isnotnull(Year" in capsys.readouterr().out
    assert df.count() == 1


def test_headers_are_found_in_a_constant_number_of_jobs(spark, tmp_path):
    heads = ["State,District,Commodity,Modal_Price", "Commodity,Modal_Price,State,District", "State,Commodity,Modal_Price,Note"]
    rows = ["Assam,d,Paddy,{n}", "Paddy,{n},Assam,d", "Assam,Paddy,{n},hi"]

    def folder(name, files):
        for n in range(files):
            write(tmp_path / name / f"{2000 + n % 20}.{n} a+b.csv", *([""] if n % 5 == 0 else []), heads[n % 3], rows[n % 3].format(n=n))
        return str(tmp_path / name)

    def jobs(path):
        group = f"headers of {path}"
        spark.sparkContext.setJobGroup(group, group)
        groups = S._by_header(spark, path)
        spark.sparkContext.setJobGroup("", "")
        return groups, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    few, many = folder("few", 6), folder("many", 600)
    groups, used = jobs(many)
    assert sorted(map(len, groups)) == [200, 200, 200] and used == jobs(few)[1]
    read = S.read_prices(spark, many)
    assert sorted(r.Modal_Price for r in read.collect()) == [float(n) for n in range(600)]
    assert {(r.State, r.Commodity) for r in read.collect()} == {("Assam", "Paddy")}


def test_access_log(spark, frame, tmp_path):
    path = str(tmp_path / "auth")
    S.append_auth_events(frame("id long, username string, action string", [(1, "ada", "LOGOUT")]), path)
    S.append_auth_events(frame("id long, username string, action string, ip_address string", [(2, "bob", "REGISTER", "10.0.0.1")]), path)
    rows = {r.id: r for r in S.read_log(spark, path, schemas.AUTH_EVENTS).collect()}
    assert rows[1].ip_address is None and rows[2].timestamp is not None
    with pytest.raises(Exception, match="unknown action"):
        S.append_auth_events(frame("id long, username string, action string", [(3, "eve", "HACK")]), path)


def test_a_year_is_written_by_several_tasks(spark):
    columns = [F.lit("1").cast(f.dataType).alias(f.name) for f in schemas.PRICES]
    years = F.when(F.col("id") % 3 == 0, 2005).otherwise(2000 + F.col("id") % 7).cast("int").alias("Year")
    prices = spark.range(3000).select(*columns[1:], F.col("id").cast("string").alias(schemas.PRICES.names[0]), years)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = _write_years(prices)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [r.name for r in spark.read.text(path).select("_metadata.file_name").distinct().toDF("name").collect()]
    assert sum(name.startswith("2005.") for name in files) > 1
    read = S.read_prices(spark, path)
    assert read.count() == 3000 and read.exceptAll(prices.select(*read.columns)).isEmpty()


def test_a_state_written_again_keeps_all_rows(spark, tmp_path):
    path = write(tmp_path / "agri.csv", AGRI, *[f"{state},D{n},2003,Rabi,Rice,2,8,X,0.5,100,-1,1" for state in ("ASSAM", "BIHAR", "") for n in (1, 1, 2)])
    agri = S.read_agri(spark, path)
    root = S.publish_states(agri, str(tmp_path / "states"))
    S.publish_states(agri.filter("State = 'ASSAM'"), root)
    again = S.read_states(spark, root)
    assert again.count() == 9 and again.drop(S.STATE_KEY).exceptAll(agri).isEmpty()
    assert again.filter(F.col(S.STATE_KEY) == "BIHAR").count() == 3
