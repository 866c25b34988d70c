"""Where events come from and where states are kept."""

from .tables import load_group, load_state, read_table, save_group, save_state, text_keys

__all__ = ["load_group", "load_state", "read_table", "save_group", "save_state", "text_keys"]
