import pytest

from quire.plans import catalog


SOME = [
    "s1_text_roundtrip", "m1_merge_islands", "c2_gridspan", "w1_list_numbers", "w1_blocks", "g4_comments", "n3_roman", "p13_links", "u1_document_sections", "i10_enum_paragraphs", "i3_iter_tables", "i8_enum_rows", "i5_iter_cells", "g1_join_runs", "p10_sections",
    "x2_replace_html", "s2_part_source", "j9_text_outside", "p7_content_controls", "w4_odd_values", "u2_many_headers", "j3_vml_images", "t17_other_tags", "p14_filler", "x3_partial", "p4_nearest", "p3_lookups", "p1_markup_without_a_tag", "s3_close", "s13_images", "p12_headings", "t4_math_symbols_images",
]


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry():
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
