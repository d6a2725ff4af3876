"""Registry of the training-data queries and of their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, decontaminate, licenses, main_text, packing, quality, sharding, simhash, suffixes, toxicity, tput, vptree, whitening


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_suffix_dedup": suffixes.op2_suffix_dedup,
        "op3_qgram_decontamination": decontaminate.op3_qgram_decontamination,
        "op4_rendezvous_sharding": sharding.op4_rendezvous_sharding,
        "op5_vp_tree_neighbours": vptree.op5_vp_tree_neighbours,
        "op6_simhash": simhash.op6_simhash,
        "op7_chat_formatting": chat.op7_chat_formatting,
        "op8_license_scan": licenses.op8_license_scan,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_quality": quality.op10_quality,
        "op11_embedding_whitening": whitening.op11_embedding_whitening,
        "op12_main_text": main_text.op12_main_text,
        "op13_tput_search": tput.op13_tput_search,
        "vp_tree_exact_search": vptree.exact_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_dedup": suffixes.sql(),
        "op4_rendezvous_sharding": sharding.sql(),
        "op7_chat_formatting": chat.sql(),
        "op8_license_scan": licenses.sql(),
        "op12_main_text": main_text.sql(),
        "op13_tput_search": tput.sql(),
        "vp_tree_exact_search": vptree.sql(),
    }
