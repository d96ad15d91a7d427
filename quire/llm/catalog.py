"""The modules that register queries."""

from . import ann, jaccard_join, language_id, line_dedup, manifest, merge_dropout, packing, quality_classifier, quality_rules, resampling, substring_dedup, toxicity, url_filters

MODULES = (packing, line_dedup, quality_rules, merge_dropout, substring_dedup, language_id, url_filters, ann, quality_classifier, jaccard_join, resampling, toxicity, manifest)
