"""Registered queries of structured data: JSON-LD that Spark makes of the supplier table, read back from raw HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import structured
from ..session import table
from .catalog import query


def _pages(spark, d):
    """A page for each supplier, with its data as JSON-LD: a graph with the supplier, and its nation nested within its address."""
    rows = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    address = F.struct(F.lit("PostalAddress").alias("@type"), F.concat("s_name", F.lit(" Quay")).alias("streetAddress"), F.struct(F.col("n_name").alias("name")).alias("addressCountry"))
    none = F.lit(None).cast("string")
    points = F.array(F.struct(F.concat(F.lit("+1 555 "), F.col("s_suppkey").cast("string")).alias("telephone"), F.lit("sales").alias("contactType"), none.alias("email")), F.struct(none.alias("telephone"), none.alias("contactType"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("@pier.org")).alias("email")))
    founder = F.when(F.col("s_suppkey") % 2 == 0, F.struct(F.concat(F.lit("Founder of "), "s_name").alias("name"), F.array(F.concat(F.lit("https://linkedin.com/in/s"), F.col("s_suppkey").cast("string"))).alias("sameAs")))
    org = F.struct(F.array(F.lit("Corporation"), F.lit("Thing")).alias("@type"), F.col("s_name").alias("name"), address.alias("address"), points.alias("contactPoint"), founder.alias("founder"))
    graph = F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.array(org).alias("@graph")))
    return rows.select("s_suppkey", F.concat(F.lit('<html><script type="application/ld+json">'), graph, F.lit("</script><p>x</p></html>")).alias("html"))


@query("SELECT s_suppkey, s_name AS name, 'corporation' AS type, CASE WHEN s_suppkey % 2 = 0 THEN 'Founder of ' || s_name END AS founder, CASE WHEN s_suppkey % 2 = 0 THEN 'https://linkedin.com/in/s' || s_suppkey END AS profile, '+1 555 ' || s_suppkey AS phone, 's' || s_suppkey || '@pier.org' AS email FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q_json_ld(spark, d):
    """Organisation, founder and contact points of each page."""
    found = structured.nodes(_pages(spark, d), "s_suppkey", "html")
    people = structured.people(found, "s_suppkey").select("s_suppkey", F.col("name").alias("founder"), F.col("linkedin").alias("profile"))
    points = structured.contact_points(found, "s_suppkey").groupBy("s_suppkey").agg(F.max("phone").alias("phone"), F.max("email").alias("email"))
    return structured.organisations(found, "s_suppkey").select("s_suppkey", "name", "type").join(people, "s_suppkey", "left").join(points, "s_suppkey", "left")


@query("SELECT s_suppkey, array_to_string([s_name || ' Quay', n_name], ', ') AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q_postal_addresses(spark, d):
    """The postal address of each page, in one line."""
    return structured.postal_addresses(_pages(spark, d), "s_suppkey", "html")
