"""Sinks: content-addressed blobs, dataset exports, builds, downloads and metric logs."""
