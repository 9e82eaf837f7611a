"""The queries of this subpackage, and the SQL of those that SQL can express."""

from . import annsearch, bpe, centroids, chat, exactsearch, mixing, resampling, secrets, simhash, tokenscan, toxicity, urls, warc

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_chat": chat.op2_chat,
    "op3_simhash": simhash.op3_simhash,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mixing": mixing.op5_mixing,
    "op6_exact_topk": exactsearch.op6_exact_topk,
    "op7_ann": annsearch.op7_ann,
    "op8_warc": warc.op8_warc,
    "op9_urls": urls.op9_urls,
    "op10_tokens": tokenscan.op10_tokens,
    "op11_resampling": resampling.op11_resampling,
    "op12_centroids": centroids.op12_centroids,
    "op13_secrets": secrets.op13_secrets,
}
ORACLE_SQL = {
    "op2_chat": chat.SQL,
    "op5_mixing": mixing.SQL,
    "op6_exact_topk": exactsearch.SQL,
    "op8_warc": warc.SQL,
    "op9_urls": urls.SQL,
    "op10_tokens": tokenscan.SQL,
    "op11_resampling": resampling.SQL,
    "op12_centroids": centroids.SQL,
}
