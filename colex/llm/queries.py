"""The queries of this package and their SQL, by the names the driver knows."""

from __future__ import annotations

from . import classifier, conversations, embeddings, html_text, jaccard, maxent, mixture, packing, rules, secrets, substring, variants, warc

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_rules": rules.op2_rules,
    "op3_html": html_text.op3_html,
    "op4_substring": substring.op4_substring,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_secrets": secrets.op7_secrets,
    "op8_classifier": classifier.op8_classifier,
    "op9_mixture": mixture.op9_mixture,
    "op10_warc": warc.op10_warc,
    "op11_conversations": conversations.op11_conversations,
    "op12_maxent": maxent.op12_maxent,
    "op13_variants": variants.op13_variants,
    "rules_ablations": rules.rules_ablations,
}
ORACLE_SQL = {
    "op2_rules": rules.OP2_SQL,
    "op9_mixture": mixture.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
    "op11_conversations": conversations.OP11_SQL,
    "op13_variants": variants.OP13_SQL,
    "rules_ablations": rules.ABLATIONS_SQL,
}
