"""veilspark: find, fuse, link, transform and evaluate personal data as Spark plans."""

__version__ = "0.1.0"
