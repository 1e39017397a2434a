"""Column functions."""

from pathmine.functions.text import (  # noqa: F401
    decode_context,
    encode_context,
    file_index,
    java_hash,
    make_label,
    normalize_token,
    pad_slots,
    split_subtokens,
)
from pathmine.functions.nodes import mask_self, normalize_node, parenthesize, parse_node_label  # noqa: F401
