"""Column-level functions: text clean-up, segmentation, packing, audio and naming helpers."""
