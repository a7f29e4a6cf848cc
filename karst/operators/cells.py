"""Dense cells of the observation cube, in the two shapes questions are answered from.

``series``: a country's values of an indicator by year.  ``vectors``: a region's values of an indicator and year, one element for every
member country in the dimension's order, null where there is no value.  Both are aggregated once, are bounded by the number of years and
of a region's countries, and are joined by equality, so a table of questions never meets the cube cell by cell.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lookup import cell_values, small


@dataclass(frozen=True)
class Cube:
    """geo(country_code, country_name, region, pos) and observations(indicator_code, country_code, year, value)."""

    geo: DataFrame
    observations: DataFrame

    def known(self) -> DataFrame:
        return cell_values(self.observations)

    def members(self) -> DataFrame:
        """(region, members): each region's countries in order."""
        listed = F.sort_array(F.collect_list(F.struct("pos", F.col("country_code").alias("code"), F.col("country_name").alias("name"))))
        return self.geo.where("region IS NOT NULL").groupBy("region").agg(listed.alias("members"))

    def series(self, asked: DataFrame | None = None) -> DataFrame:
        """(country_code, indicator_code, by_year); ``asked(property)`` are the rows that will meet it, for cubes that can prune by them."""
        return self.known().groupBy("country_code", "indicator_code").agg(F.map_from_entries(F.collect_list(F.struct("year", "value"))).alias("by_year"))

    def vectors(self, asked: DataFrame | None = None) -> DataFrame:
        """(region, indicator_code, year, have); ``asked`` as for series."""
        home = small(self.geo.select("country_code", "region"))
        have = self.known().join(home, "country_code").where("region IS NOT NULL").groupBy("region", "indicator_code", "year")
        return have.agg(F.map_from_entries(F.collect_list(F.struct("country_code", "value"))).alias("have"))

    def dense(self) -> DataFrame:
        """The whole grid country x indicator x year, as rows (for cubes whose grid is wanted itself)."""
        known = self.known()
        grid = self.geo.crossJoin(known.select("indicator_code").distinct()).crossJoin(known.select("year").distinct())
        return grid.join(known, ["country_code", "indicator_code", "year"], "left")


def with_series(questions: DataFrame, cube: Cube, subjects: list[str]) -> DataFrame:
    """Adds ``s_<slot>``, the by-year map of each subject slot's country."""
    series = cube.series(questions.select("property"))
    for slot in subjects:
        side = series.select(F.col("country_code").alias(slot), F.col("indicator_code").alias("property"), F.col("by_year").alias(f"s_{slot}"))
        questions = questions.join(side, [slot, "property"], "left")
    return questions


def with_vectors(questions: DataFrame, cube: Cube, wanted: list[tuple[str, str]]) -> DataFrame:
    """Adds ``v_<region>_<year>`` for each (region slot, year slot): an array of (code, name, value), dense."""
    vectors = cube.vectors(questions.select("property"))
    members = small(cube.members(), cube.geo)
    for slot in dict.fromkeys(r for r, _ in wanted):
        questions = questions.join(members.select(F.col("region").alias(slot), F.col("members").alias(f"m_{slot}")), slot, "left")
    for slot, year in wanted:
        side = vectors.select(F.col("region").alias(slot), F.col("indicator_code").alias("property"), F.col("year").alias(year), "have")
        questions = questions.join(side, [slot, "property", year], "left")
        value = lambda m: F.struct(m["code"].alias("code"), m["name"].alias("name"), F.try_element_at(F.col("have"), m["code"]).alias("value"))
        questions = questions.withColumn(f"v_{slot}_{year}", F.transform(f"m_{slot}", value)).drop("have")
    return questions
