"""Lives from categories, rule by rule."""

import pytest

from pagegraph.functions import titles


@pytest.mark.parametrize(
    ("categories", "life", "debut"),
    [
        (["1900_births", "1980_deaths"], "1900–1980", ""), (["1950_births", "Living_people"], "born 1950", ""), (["1850_births"], "1850–?", ""), (["1600_births"], "born 1600", ""), (["1850_births", "Living_people"], "1850–?", ""), (["1980_deaths"], "died 1980", ""),
        (["47_BC_births", "12_deaths"], "47 BC–12 AD", ""), (["47_BC_births", "5_BC_deaths"], "47–5 BC", ""), (["47_births"], "born 47 AD", ""), (["120_deaths"], "died 120", ""), (["1570s_births", "1630_deaths"], "1570s–1630", ""),
        (["Year_of_birth_missing", "Year_of_death_missing"], "", ""), (["Year_of_birth_unknown", "1598_deaths"], "died 1598", ""), (["Year_of_birth_unknown", "2020_deaths"], "?–2020", ""), (["Year_of_birth_uncertain", "47_BC_deaths"], "?–47 BC", ""), (["Year_of_death_unknown"], "", ""),
        (["1990_births", "Year_of_death_unknown"], "1990–?", ""), (["1990_births", "Missing_people"], "born 1990", ""), (["1700_births", "Missing_people"], "1700–?", ""), (["1999_albums", "1987_songs", "1987_EPs", "1950_establishments"], "", "1987 1999"), (["2nd-century_BC_births", "Living_people"], "", ""),
        (["1901_births", "1900_births"], "born 1901", ""), (["47_BC_births", "Year_of_death_unknown"], "47 BC–?", ""),
    ],
)
def test_lives(spark, categories, life, debut):
    links = spark.createDataFrame([(1, c) for c in [*categories, "Other_things"]], "cl_from long, cl_to string")
    got = titles.category_lifespans(links, 2024).collect()
    assert [(r.life, r.debut) for r in got] == [(life, debut)]


def test_pages_that_tell_nothing(spark):
    links = spark.createDataFrame([(1, "Towns_of_1875"), (2, None), (None, "1900_births")], "cl_from long, cl_to string")
    assert [(r.cl_from, r.life) for r in titles.category_lifespans(links, 2024).collect()] == [(None, "born 1900")]
    assert titles.category_lifespans(links.limit(0), 2024).collect() == []
