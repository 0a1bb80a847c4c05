"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from quillmill.llm.bpe import op1_bpe
from quillmill.llm.html import op6_html
from quillmill.llm.jaccard import op7_jaccard
from quillmill.llm.linededup import op8_linededup
from quillmill.llm.lm import op2_lm
from quillmill.llm.media import op10_media
from quillmill.llm.neardup import op3_embeddings
from quillmill.llm.negatives import ORACLE as NEGATIVES_SQL
from quillmill.llm.negatives import op13_negatives
from quillmill.llm.packing import op5_packing
from quillmill.llm.resample import ORACLE as RESAMPLE_SQL
from quillmill.llm.resample import op12_resample
from quillmill.llm.rules import ORACLE as RULES_SQL
from quillmill.llm.rules import op11_quality
from quillmill.llm.secrets import op4_secrets
from quillmill.llm.toxicity import op9_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_lm": op2_lm,
    "op3_embeddings": op3_embeddings,
    "op4_secrets": op4_secrets,
    "op5_packing": op5_packing,
    "op6_html": op6_html,
    "op7_jaccard": op7_jaccard,
    "op8_linededup": op8_linededup,
    "op9_toxicity": op9_toxicity,
    "op10_media": op10_media,
    "op11_quality": op11_quality,
    "op12_resample": op12_resample,
    "op13_negatives": op13_negatives,
}

GROUPS = (
    "ends AS (SELECT a, b FROM e UNION SELECT b, a FROM e), "
    "r(id, root) AS (SELECT {id}, {id} FROM {table} UNION SELECT ends.b, r.root FROM r JOIN ends ON ends.a = r.id WHERE r.root < ends.b), "
    "g AS (SELECT id, min(root) AS root FROM r GROUP BY 1) "
)
LETTERS = "abcdefghijklmnopqrstuvwxyz"
ORACLES: dict[str, str] = {
    "op3_embeddings": (
        "WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), "
        "e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.9), "
        + GROUPS.format(id="vec_id", table="embeddings")
        + "SELECT vec_id, (SELECT count(*) FROM ends WHERE a = vec_id) AS n_links, root AS component_id, vec_id = root AS kept FROM embeddings JOIN g ON vec_id = id"
    ),
    "op7_jaccard": (
        f"WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{LETTERS.upper()}', '{LETTERS}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents), "
        "s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w), "
        "n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), "
        "p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2), "
        "e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)), "
        + GROUPS.format(id="doc_id", table="documents")
        + "SELECT d.doc_id, coalesce(n, 0) AS n_shingles, root AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN g ON d.doc_id = id"
    ),
    "op11_quality": RULES_SQL,
    "op12_resample": RESAMPLE_SQL,
    "op13_negatives": NEGATIVES_SQL,
}
