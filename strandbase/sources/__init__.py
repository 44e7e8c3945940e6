"""Intake: archives with compiled classes and manifests, text manifests, and the Parquet tables made of them."""
