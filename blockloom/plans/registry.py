"""All queries of the texture operators with their SQL."""

from blockloom.plans import applied, blocks, census, cluster, encoding, files, fits, scalars, scale, tables

MODULES = (applied, scalars, tables, blocks, census, cluster, encoding, files, fits, scale)
#: Queries that read no table: scalars over their whole domain, lookup tables by their rule, generated blocks. They are held
#: against their SQL by the tests, but work on fixed input, so that they are no queries over data.
FIXED_INPUT = {
    "sc1_reconstructor", "sc2_reconstruct", "sc3_sc4_residual_coder", "agg13_residual_range", "sc5_sc6_srgb", "sc7_sc8_quantisers", "sc9_quantiser_table",
    "sc10_odd_floor", "sc11_division", "sc11_division_search", "sc12_interpolants", "sc13_sc15_endpoints", "sc14_weights", "src6_sc17_sc29_pyramid",
    "sc24_sc25_half_decode", "sc26_sc27_half_encode", "src7_colour_table", "sc28_packed_table", "src7_worst_errors", "agg15_fit_sums",
    "agg15_fit_sums_four", "jn10_swapped_codes", "src7_compact_tables", "agg15_deltas", "agg4_round_trip", "src3_src5_generated", "prj4_prj8_flt1_sizes",
    "prj9_dec6_volume_blocks", "flt7_updates", "prj8_volume_sizes", "jn8_members", "win1_first_texels", "win2_anchors", "sc18_byte_masks",
    "agg5_agg6_flt5_codebooks", "agg7_ends_of_books", "agg7_end_sets", "agg12_jn7_jn9_coverage", "agg4_src4_src5_harness", "flt4_same_sizes",
    "prj7_options",
    *(f"src7_{name}" for name in tables.PALETTES),
}
ALL: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ALL_SQL: dict[str, str] = {name: s for m in MODULES for name, s in m.SQL.items()}
QUERIES: dict = {name: f for name, f in ALL.items() if name not in FIXED_INPUT}
RULES: dict = {name: ALL[name] for name in sorted(FIXED_INPUT)}
ORACLE_SQL: dict[str, str] = {name: s for name, s in ALL_SQL.items() if name in QUERIES}
