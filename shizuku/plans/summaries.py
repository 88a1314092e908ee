"""The declared summaries of the occurrence cube: what they group by and measure."""

_YEARS = {"grain": ["year", "survey_period"]}
_BOTH = {"place_kind": ["grid01", "watershed"], **_YEARS}
_YEAR = {"expr": "year_of_period_start"}
_AT = {"w": {"place_kind": "watershed"}, "g": {"place_kind": "grid01"}}
_SPAN = {"y_from": {"fn": "min", **_YEAR}, "y_to": {"fn": "max", **_YEAR}}
_N = {c: {"fn": "sum", "col": c} for c in ("n", "n_red_list", "n_alien")}
_EFFORT = {
    "n": {"fn": "sum", "col": "n", "when": _AT["w"]},
    "n_binom": {"fn": "count_distinct", "col": "taxon.binom"},
    "n_places": {"fn": "count_distinct", "col": "place_id", "when": _AT["g"]},
}
_WINDOW = {"year_between": [1996, 1999]}

SPECS = {
    "sum_taxon_catalog": {
        "by_region": True,
        "source": "occurrence_agg",
        "filter": {"place_kind": "grid01", **_YEARS},
        "group_by": ["taxon_id"],
        "measures": {**_N, "n_places": {"fn": "count_distinct", "col": "place_id"}, **_SPAN, "n_years": {"fn": "count_distinct", **_YEAR}},
        "key": ["taxon_id"],
    },
    "sum_watershed_occurrence": {
        "source": "occurrence_agg",
        "filter": {"place_kind": "watershed", **_YEARS},
        "group_by": ["place_id"],
        "measures": {**_N, "n_taxa": {"fn": "count_distinct", "col": "taxon_id"}, **_SPAN},
        "key": ["place_id"],
    },
    "sum_species_catalog": {
        "by_region": True,
        "source": "occurrence_agg",
        "join": {"taxon": "registry"},
        "filter": {**_BOTH, "taxon.binom": {"not_null": True}},
        "columns": {"binom": {"col": "taxon.binom"}},
        "group_by": ["binom"],
        "measures": {
            "taxon_group": {"fn": "max", "col": "taxon.taxon_group"},
            "n": {"fn": "sum", "col": "n", "when": _AT["w"]},
            "n_located": {"fn": "sum", "col": "n", "when": _AT["g"]},
            "n_red_list": {"fn": "sum", "col": "n_red_list", "when": _AT["w"]},
            "n_alien": {"fn": "sum", "col": "n_alien", "when": _AT["w"]},
            "n_places": {"fn": "count_distinct", "col": "place_id", "when": _AT["g"]},
            **_SPAN,
            "n_years": {"fn": "count_distinct", **_YEAR},
        },
        "key": ["binom"],
    },
    "sum_group_year": {
        "source": "occurrence_agg",
        "join": {"taxon": "registry"},
        "filter": _BOTH,
        "columns": {"year": _YEAR, "taxon_group": {"col": "taxon.taxon_group", "coalesce": "未判定"}},
        "group_by": ["year", "taxon_group", "source_id"],
        "measures": _EFFORT,
        "key": ["year", "taxon_group", "source_id"],
    },
    "sum_effort_year": {
        "by_region": True,
        "source": "occurrence_agg",
        "join": {"taxon": "registry"},
        "filter": _BOTH,
        "columns": {"year": _YEAR},
        "group_by": ["year"],
        "measures": _EFFORT,
        "key": ["year"],
    },
    "sum_grid_catalog": {
        "source": "occurrence_agg",
        "join": {"taxon": "registry"},
        "filter": {"place_kind": "grid01", **_YEARS},
        "group_by": ["place_id"],
        "measures": {
            "n": {"fn": "sum", "col": "n", "when": _WINDOW},
            "n_red_list": {"fn": "sum", "col": "n_red_list", "when": _WINDOW},
            "n_binom": {"fn": "count_distinct", "col": "taxon.binom"},
            "n_red_binom": {"fn": "count_distinct", "col": "taxon.binom", "when": {"positive": "n_red_list"}},
        },
        "key": ["place_id"],
    },
}
