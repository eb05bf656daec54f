"""The numbered problems' queries and the SQL they can be checked with."""

from __future__ import annotations

from cellmill.llm import clusters, coverage, leaks, mixing, neighbours, proportional, reading, topn


def queries():
    return {
        "p1_found": proportional.p1_found,
        "p1_draw": proportional.p1_draw,
        "p1_shares": proportional.p1_shares,
        "p2_found": clusters.p2_found,
        "p2_clusters": clusters.p2_clusters,
        "p3_found": coverage.p3_found,
        "p3_select": coverage.p3_select,
        "p4_found": neighbours.p4_found,
        "p4_neighbours": neighbours.p4_neighbours,
        "p5_found": topn.p5_found,
        "p5_top": topn.p5_top,
        "p6_found": leaks.p6_found,
        "p6_items": leaks.p6_items,
        "p7_found": mixing.p7_found,
        "p7_mix": mixing.p7_mix,
        "p7_shares": mixing.p7_shares,
        "p8_found": reading.p8_found,
        "p8_grades": reading.p8_grades,
    }


def oracle_sql():
    return {
        "p1_found": proportional.P1_FOUND_SQL,
        "p2_found": clusters.P2_FOUND_SQL,
        "p3_found": coverage.P3_FOUND_SQL,
        "p4_found": neighbours.P4_FOUND_SQL,
        "p5_found": topn.P5_FOUND_SQL,
        "p5_top": topn.P5_TOP_SQL,
    }
