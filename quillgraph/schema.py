"""Table schemas and the vocabulary of the document graph.

Order is data: Spark rows have none, so every table that has a meaningful order carries a `seq` column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Node and edge vocabulary, edge difficulty and question type, and constant edge weights.
NODE_TYPES = ("Paper", "Figure", "Table", "Equation", "TextBlock", "Concept", "Claim")
VISUAL_TYPES = ("Figure", "Table")
EDGE_DIFFICULTY = {
    "CONTAINS": 1, "HAS_CAPTION": 1,
    "DEFINES": 2, "QUANTIFIES": 2, "SUPPORTS": 2, "ILLUSTRATES": 2, "REFERENCES": 2,
    "DERIVES_FROM": 3, "COMPARES": 3, "CONTRADICTS": 3,
    "SAME_CONCEPT": 4, "CROSS_DOC": 4,
}
EDGE_QUESTION_TYPE = {
    "CONTAINS": "VQA", "HAS_CAPTION": "VQA", "DEFINES": "VQA", "QUANTIFIES": "VQA", "ILLUSTRATES": "VQA",
    "SUPPORTS": "Reasoning", "REFERENCES": "Reasoning", "DERIVES_FROM": "Reasoning", "CONTRADICTS": "Reasoning",
    "COMPARES": "MCQ",
    "SAME_CONCEPT": "InstructionFollowing", "CROSS_DOC": "InstructionFollowing",
}
QUESTION_TYPES = ("VQA", "Reasoning", "MCQ", "InstructionFollowing")
CONTAINS_WEIGHT, CAPTION_WEIGHT, REFERENCE_WEIGHT, REFERENCE_CONFIDENCE = 0.3, 0.5, 0.8, 0.9
RELATION_WEIGHT, RELATION_CONFIDENCE = 0.85, 0.8
CONCEPT_WEIGHT, CONCEPT_CONFIDENCE = 0.9, 0.75

LAYOUT = """
document_path string, total_pages int,
pages array<struct<
  page_number int,
  title_elements array<struct<text string, confidence double>>,
  author_elements array<struct<text string, confidence double>>,
  text_elements array<struct<text string, confidence double>>,
  visual_elements array<struct<image_path string, caption string, confidence double>>,
  table_elements array<struct<text string, image_path string, caption string, html string, confidence double>>>>
"""
ELEMENTS = "paper_id string, page int, page_pos int, kind_rank int, elem_pos int, element_type string, content string, image_path string, confidence double, caption string"
NODES = """
node_id string, node_type string, paper_id string, page int, content string, image_path string, seq bigint,
section_title string, depth int, is_section boolean, is_caption boolean, confidence double, has_image boolean
"""
EDGES = "src_id string, dst_id string, edge_type string, weight double, confidence double, method string, evidence string, seq bigint"
PAIRS = """
pair_id string, question string, chosen string, rejected string, paper_id string, created_at string, lang string,
question_source string, question_type string, difficulty int,
kg_provenance struct<src_node string, edge string, dst_node string, hop int, path array<string>, edges array<string>>,
gold_answer string, image_paths array<string>, candidates array<string>, chosen_idx int, rejected_idx int,
annotator string, model_version string, notes string, status string
"""
EVAL_ITEMS = """
question_id string, question string, question_type string, ground_truths array<string>, image_paths array<string>,
context string, paper_id string, difficulty int
"""
HISTORY = "checkpoint string, step int, loss double, eval map<string,double>, n_train_pairs int, timestamp string, notes string"
COMPARISONS = """
checkpoint string, verdict string, question string, images array<string>, base_answer string, tuned_answer string,
temperature double, identical boolean, note string, annotator string, created_at string
"""


def field_names(ddl: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).names


def lookup(table: dict, key: Column, default) -> Column:
    """A fixed table as an expression."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))
