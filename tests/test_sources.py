import random

import pytest

from catalign.plans.harmonize import run
from catalign.sources.files import PLACE, Dialect, UnreadableFile, bad_rows, clean_headers, detect_dialect, load_catalog, read_csv, write_csv


def write(folder, name, text, encoding="utf-8"):
    path = folder / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def rows(df):
    return sorted(map(tuple, df.drop(*PLACE).collect()), key=repr)


def test_semicolon_wins_and_bom_goes(spark, tmp_path):
    path = write(tmp_path, "a.csv", "name;price,eur\nbolt;1,5\n", "utf-8-sig")
    df = read_csv(spark, path)
    assert df.columns[:2] == ["name", "price,eur"] and rows(df) == [("bolt", "1,5")]


def test_cyrillic_single_byte_file(spark, tmp_path):
    path = write(tmp_path, "a.csv", "код,цена\nгайка,5\n", "cp1251")
    dialect = detect_dialect(spark, path)
    assert dialect.encoding == "cp1251" and dialect.columns == ("код", "цена")
    assert rows(read_csv(spark, path)) == [("гайка", "5")]


@pytest.mark.parametrize("raw,encoding", [(b"\x98", "cp1252"), (b"\x98\x81", "latin-1")])
def test_undecodable_bytes_move_to_the_next_encoding(spark, tmp_path, raw, encoding):
    path = tmp_path / "a.csv"
    path.write_bytes(b"a,b\nx" + raw + b",2\n")
    assert detect_dialect(spark, str(path)).encoding == encoding
    assert read_csv(spark, str(path)).first()["a"] == "x" + raw.decode(encoding)


def test_long_rows_go_short_rows_fill(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b,c\n1,2,3\n1,2,3,4\n5,6\n"x ""q"", y",7,8\n9,"in 55""",z\n')
    assert rows(read_csv(spark, path)) == sorted(
        [("1", "2", "3"), ("5", "6", None), ('x "q", y', "7", "8"), ("9", 'in 55"', "z")], key=repr
    )


def test_raw_inch_mark_and_line_break(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b\ntv 55",1\n"two\nlines",2\n')
    assert rows(read_csv(spark, path)) == [('tv 55"', "1"), ("two\nlines", "2")]


def test_surplus_fields_make_a_row_bad_even_after_empty_ones(spark, tmp_path):
    path = write(tmp_path, "a.csv", 'a,b,c\n1,2,3\n4,5,6,,7\n4,5,6,\n"x,y",5,6\n"x,y",5,6,"7,8"\ntv 55",1,2\n')
    assert rows(read_csv(spark, path)) == sorted([("1", "2", "3"), ("x,y", "5", "6"), ('tv 55"', "1", "2")], key=repr)
    assert [tuple(r) for r in bad_rows(spark, path).collect()] == [("a.csv", 3, 3)]
    assert not detect_dialect(spark, path).multi_line
    assert read_csv(spark, path).select("b").count() == 3
    assert sorted(r["c"] for r in read_csv(spark, path).select("c").collect()) == ["2", "3", "6"]


def test_rows_of_a_folder_are_ordered_by_file_name(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "part-0.csv", "Product Name,Category\n" + "".join(f"a{i},x\n" for i in range(3)))
    write(tmp_path / "in", "part-1.csv", "Product Name,Category\n" + "".join(f"b{i},x\n" for i in range(300)))
    df = load_catalog(spark, [str(tmp_path / "in")]).catalog
    assert [r["product_name"] for r in df.orderBy("row_id").limit(4).collect()] == ["a0", "a1", "a2", "b0"]


def test_other_separator_is_guessed(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a|b|c\n1|2|3\n4|5|6\n")
    assert rows(read_csv(spark, path)) == [("1", "2", "3"), ("4", "5", "6")]


def test_headers_are_cleaned_and_made_unique():
    assert clean_headers([' "A" ', "'b'", "b", "b", "﻿c"]) == ["A", "b", "b.1", "b.2", "c"]


@pytest.mark.parametrize("text", ["", "only\n1\n2\n", "a,b\n"])
def test_unreadable_files(spark, tmp_path, text):
    with pytest.raises(UnreadableFile):
        detect_dialect(spark, write(tmp_path, "a.csv", text))


def test_catalog_of_several_files(spark, tmp_path):
    one = write(tmp_path, "one.csv", "Product Name,Category,SKU,Weight\nbolt,parts,S1,N/A\nnut,parts,S2,2 kg\n")
    bad = write(tmp_path, "bad.csv", "x\n1\n")
    two = write(tmp_path, "two.csv", "name;cat;Power\nlamp;lights;5 W\n")
    df, failed, counts = load_catalog(spark, [one, bad, two])
    assert sorted(map(tuple, counts.collect())) == [("one.csv", 2, 0), ("two.csv", 1, 0)]
    assert failed == [bad]
    assert df.columns == ["row_id", "product_name", "source_file", "category", "SKU", "Weight", "Power", "group_name"]
    assert [tuple(r) for r in df.orderBy("row_id").collect()] == [
        (0, "bolt", "one.csv", "parts", "S1", None, None, "parts"),
        (1, "nut", "one.csv", "parts", "S2", "2 kg", None, "parts"),
        (2, "lamp", "two.csv", "lights", "lamp", None, "5 W", "lights"),
    ]
    with pytest.raises(UnreadableFile):
        load_catalog(spark, [bad])


def serial(spark, path, names):
    """The reader that takes a whole file in one task."""
    return spark.read.csv(path, schema=", ".join(f"{c} string" for c in names), header=True, multiLine=True, escape='"', enforceSchema=True)


@pytest.mark.parametrize("seed", range(4))
def test_ranges_of_quoted_files_give_the_rows_of_a_serial_read(spark, tmp_path, seed):
    rng = random.Random(seed)
    end = "\r\n" if seed == 3 else "\n"

    def field():
        text = "".join(rng.choice(['"', ",", "\n", "a", "bc ", " ", "é", end]) for _ in range(rng.randrange(12)))
        if rng.random() < 0.2:
            text += "x" * rng.randrange(400)
        bare = not set(text) & set('",\n\r') and text.strip() != ""
        return text if bare else '"' + text.replace('"', '""') + '"'

    lines = ["a,b,c"] + [",".join([f"r{i}", field(), field()]) + (end if rng.random() < 0.1 else "") for i in range(120)]
    path = write(tmp_path, "a.csv", end.join(lines) + (end if seed % 2 else ""))
    dialect = Dialect("utf-8", ",", True, True, ("a", "b", "c"))
    # The serial reader takes carriage returns out of fields where lines end with them.
    plain = lambda table: sorted((tuple(v and v.replace("\r\n", "\n") for v in r) for r in table), key=repr)
    want = plain(serial(spark, path, "abc").collect())
    assert len(want) == 120
    for split_bytes in (300, 1 << 20):
        assert plain(rows(read_csv(spark, path, dialect, split_bytes))) == want
    placed = read_csv(spark, path, dialect, 300).orderBy(*PLACE).select("a", "_block").collect()
    assert [r["a"] for r in placed] == [f"r{i}" for i in range(120)] and len({r["_block"] for r in placed}) > 10


def test_a_field_longer_than_many_ranges_and_an_open_one(spark, tmp_path):
    long = "\n".join(f'line {i} ""q""' for i in range(500))
    path = write(tmp_path, "a.csv", f'a,b\n1,"{long}"\n2,"in 55"" x"\n3,tv 55" y\n4,"open\nnever\nclosed')
    got = {r["a"]: r["b"] for r in read_csv(spark, path, split_bytes=300).collect()}
    assert got["1"] == long.replace('""', '"') and got["2"] == 'in 55" x' and got["3"] == 'tv 55" y' and len(got) == 4


def test_small_ranges_are_read_many_to_a_task(spark, tmp_path):
    path = write(tmp_path, "a.csv", "a,b\n" + "".join(f'{i},"one\ntwo, {i}"\n' for i in range(1500)))
    df = read_csv(spark, path, split_bytes=100)
    assert len({r["_block"] for r in df.select("_block").distinct().collect()}) > 150
    assert len(df.inputFiles()) <= 4 * spark.sparkContext.defaultParallelism
    assert rows(df) == sorted(((str(i), f"one\ntwo, {i}") for i in range(1500)), key=repr)


def test_multi_line_files_of_a_folder_in_a_single_byte_encoding(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in ("b c", "a+1"):
        write(tmp_path / "in", f"{name}.csv", f'код;текст\n1;"до\nпосле {name}"\n\n2;x;y\n3;z\n', "cp1251")
    path = str(tmp_path / "in")
    assert rows(read_csv(spark, path, split_bytes=10)) == [("1", "до\nпосле a+1"), ("1", "до\nпосле b c"), ("3", "z"), ("3", "z")]
    assert sorted(map(tuple, bad_rows(spark, path).collect())) == [("a+1.csv", 2, 1), ("b c.csv", 2, 1)]
    catalog = load_catalog(spark, [path]).catalog
    assert [r["source_file"] for r in catalog.orderBy("row_id").collect()] == ["a+1.csv"] * 2 + ["b c.csv"] * 2


def test_csv_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 'say "hi"'), (1, "a,b")], "row_id int, t string")
    write_csv(df, str(tmp_path / "out"), "row_id")
    assert rows(read_csv(spark, str(tmp_path / "out"))) == [("1", "a,b"), ("2", 'say "hi"')]


def test_all_jobs_in_sequence(spark, tmp_path):
    one = write(tmp_path, "one.csv", "Product Name,Category,SKU,Weight (kg),Color\n" + "".join(f"lamp {i},Desk Lamps,A{i},{i}.5,red\n" for i in range(8)))
    two = write(tmp_path, "two.csv", "Product Name,Category,SKU,Weight,Colour\n" + "".join(f"lamp {i},Desk Lamp,B{i},{i} kg,blue\n" for i in range(8)))
    out = run(spark, [one, two], str(tmp_path / "out"), eps=0.3)
    final = spark.read.parquet(out["harmonized"])
    assert {r["group_name"] for r in final.collect()} == {"Desk Lamps"}
    merged = spark.read.parquet(out["merged"])
    assert "Color_Colour_merged" in merged.columns and merged.filter("Color_Colour_merged IS NULL").count() == 0
    standard = spark.read.parquet(out["standardized"])
    weights = next(c for c in standard.columns if c.startswith("Weight (kg) ("))
    assert {r[0] for r in standard.select(weights).collect()} >= {"0.5 kg", None}
