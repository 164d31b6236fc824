"""taskspace: typed expressions, task parameter spaces, file manifests and directive streams as Spark plans."""

__version__ = "0.1.0"
