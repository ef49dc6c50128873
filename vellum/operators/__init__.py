"""DataFrame -> DataFrame operators: look-back datasets, profiles, metrics, classifiers,
contrastive losses and the projection fit, text encoders."""
