"""All queries of the training-data operators, with DuckDB counterparts where SQL can say them."""

from loomarc.llm import budget, canonical, conversations, encode, languages, mixture, pairs, secrets, splitting

QUERIES = {
    "p1_found": pairs.found,
    "p1_report": pairs.defect_report,
    "p3_found": splitting.found,
    "p3_pieces": splitting.pieces,
    "p3_checks": splitting.piece_checks,
    "p3_frames": splitting.frames,
    "p4_found": secrets.found,
    "p4_redacted": secrets.redacted,
    "p5_budget": budget.p5_budget,
    "p5_document_tokens": budget.p5_document_tokens,
    "p6_found": canonical.found,
    "p6_forms": canonical.forms,
    "p6_gold_forms": canonical.gold_forms,
    "p7_found": conversations.found,
    "p7_turns": conversations.conversation_turns,
    "p7_report": conversations.window_report,
    "p8_ids": encode.p8_ids,
    "p8_lengths": encode.p8_lengths,
    "p9_mixture": mixture.p9_mixture,
    "p9_shares": mixture.p9_shares,
    "p10_found": languages.found,
    "p10_documents": languages.document_languages,
    "p10_segments": languages.segment_languages,
}
ORACLE: dict[str, str] = {**splitting.ORACLE}
