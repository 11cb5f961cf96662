"""Tables that cut lineage, in the folder that the whole cluster shares."""

from strandline.storage import KEY, clear, fresh_folder, saved, shared_dir

__all__ = ["KEY", "clear", "fresh_folder", "saved", "shared_dir"]
