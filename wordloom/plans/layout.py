"""Where the tables of one library lie and how they are cut."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """Folders under ``root``. ``bins`` and ``text_buckets`` are fixed for the life of the library.

    Choose them so that a bin and a bucket hold some files of ordinary size: the defaults suit
    millions of texts, 100 TB need thousands.
    """

    root: str
    bins: int = 500
    text_buckets: int = 500

    @property
    def manifest(self) -> str:
        """The live generations, one slot per version, the oldest one replaced by the next."""
        return f"{self.root}/manifest"

    @property
    def batches(self) -> str:
        """The batches that were appended, by epoch: the version of the manifest they were appended under."""
        return f"{self.root}/batches"

    @property
    def staging(self) -> str:
        """Postings as they were appended, by epoch."""
        return f"{self.root}/staging"

    @property
    def arrived(self) -> str:
        """Texts as they were appended, by epoch and write."""
        return f"{self.root}/arrived"

    @property
    def texts(self) -> str:
        return f"{self.root}/texts"

    @property
    def index(self) -> str:
        return f"{self.root}/index"

    @property
    def vocabulary(self) -> str:
        return f"{self.root}/vocabulary"

    @property
    def state(self) -> str:
        return f"{self.root}/state"
