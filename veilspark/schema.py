"""Column layouts of the engine's tables.

blocks      doc_id, page_number, block_ord, block_type, text, bbox        (one row per block, in reading order)
detections  doc_id, page_number, block_ord, detector_name, detector_ord, detection_type, text, start, end, bbox,
            confidence, reasons, pattern_ord                              (start and end: characters within the block)
"""

from __future__ import annotations

BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
WORD = f"struct<text:string,bbox:{BBOX}>"
BLOCKS = f"doc_id bigint, page_number int, block_ord int, block_type string, text string, bbox {BBOX}"
DETECTIONS = (
    "doc_id bigint, page_number int, block_ord int, detector_name string, detector_ord int, detection_type string, text string, "
    f"`start` int, `end` int, bbox {BBOX}, confidence double, reasons array<string>, pattern_ord int"
)
DETECTION_COLUMNS = ["doc_id", "page_number", "block_ord", "detector_name", "detector_ord", "detection_type", "text", "start", "end", "bbox", "confidence", "reasons", "pattern_ord"]
