"""Published ranking of 80 ligands: fixed values, used as a golden table."""

COLUMNS = "ligand_id score_cox1 score_cox2 geo_score QSAR_score qsar_norm geo_norm vina_norm final_score".split()

ROWS = """
A60C24S -7.37 -6.92 5.0 8.163366294258832 0.9240506329113924 0.9873417721518988 0.38607594936708856 0.8956
A40C14S -7.35 -6.38 6.0 8.110301799811882 0.9493670886075949 1.0 0.20253164556962022 0.8949
A42C30S -8.52 -9.45 3.0 7.881558623685886 0.9873417721518988 0.5886075949367089 0.9493670886075949 0.8241
A70C29S -7.76 -8.07 3.0 7.943996219092254 0.9620253164556962 0.5886075949367089 0.7721518987341772 0.7937
A47C32S -7.6 -7.89 3.0 8.15105339199162 0.9367088607594937 0.5886075949367089 0.7278481012658228 0.7766
A34C7S -7.15 -6.85 3.0 7.843126195324564 1.0 0.5886075949367089 0.35443037974683544 0.7709
A17C9N55 -7.94 -7.05 3.0 8.330706678417059 0.8987341772151899 0.5886075949367089 0.4493670886075949 0.7297
A78C7S -8.07 -6.55 3.0 8.171727590694172 0.9113924050632911 0.5886075949367089 0.2911392405063291 0.7203
A48C27N60 -7.82 -7.73 3.0 8.38708093613601 0.810126582278481 0.5886075949367089 0.6835443037974683 0.7089
A63C9N53 -7.9 -6.88 3.0 8.336713690255625 0.8734177215189873 0.5886075949367089 0.36708860759493667 0.7089
A14C34N14 -8.07 -8.8 3.0 8.443009759934261 0.7468354430379747 0.5886075949367089 0.8734177215189873 0.6962
A2C34N33 -7.66 -6.92 3.0 8.376794404838066 0.8354430379746836 0.5886075949367089 0.38607594936708856 0.6918
A94C11N1 -6.96 -5.66 3.0 8.33310894879694 0.8860759493670887 0.5886075949367089 0.06329113924050633 0.6848
A100C18N40 -8.3 -6.42 3.0 8.375735130649979 0.8481012658227848 0.5886075949367089 0.240506329113924 0.6835
A94C26N59 -8.02 -6.98 3.0 8.403913012430056 0.7974683544303798 0.5886075949367089 0.40506329113924056 0.6747
A39C30N51 -8.37 -7.52 3.0 8.432893815340345 0.759493670886076 0.5886075949367089 0.5696202531645569 0.6722
A91C35N11 -8.07 -7.04 3.0 8.408032480304355 0.7721518987341772 0.5886075949367089 0.42405063291139244 0.6639
A53C12N29 -7.98 -6.15 3.0 8.379459848158163 0.8227848101265822 0.5886075949367089 0.1392405063291139 0.6608
A86C34N46 -8.24 -8.32 3.0 8.479934118322575 0.6835443037974683 0.5886075949367089 0.8354430379746836 0.6608
A76C27N53 -9.49 -7.05 3.0 8.481260415208233 0.6708860759493671 0.5886075949367089 0.4493670886075949 0.6158
A17C38N48 -10.32 -9.53 3.0 8.583598339392998 0.5569620253164558 0.5886075949367089 0.9620253164556962 0.6101
A43C39N59 -7.9 -6.43 3.0 8.470914452192222 0.6962025316455696 0.5886075949367089 0.25316455696202533 0.6089
A89C24N55 -7.13 -8.29 3.0 8.574948483855465 0.5822784810126582 0.5886075949367089 0.8227848101265822 0.6089
A17C15N5 -8.04 -6.12 3.0 8.446925157081512 0.7215189873417722 0.5886075949367089 0.11392405063291144 0.6076
A17C3N24 -8.57 -8.38 3.0 8.579146929524654 0.5696202531645569 0.5886075949367089 0.8481012658227848 0.6051
A30C32N24 -6.49 -5.37 3.0 8.455620976180253 0.7088607594936709 0.5886075949367089 0.025316455696202556 0.5924
A100C18N37 -8.28 -9.36 3.0 8.610106315154813 0.49367088607594933 0.5886075949367089 0.9240506329113924 0.5747
A47C2N37 -8.5 -8.4 3.0 8.610902685810752 0.4810126582278481 0.5886075949367089 0.8607594936708861 0.562
A91C29N11 -7.69 -7.89 3.0 8.59642431815021 0.5063291139240507 0.5886075949367089 0.7278481012658228 0.5614
A42C43N37 -8.71 -6.14 3.0 8.516172606198673 0.620253164556962 0.5886075949367089 0.12658227848101267 0.5582
A9C26N48 -9.48 -6.26 3.0 8.564761135225114 0.5949367088607596 0.5886075949367089 0.16455696202531644 0.5494
A10C15N26 -8.97 -5.76 3.0 8.545252575785494 0.6075949367088608 0.5886075949367089 0.07594936708860756 0.5468
A89C27S -6.38 -7.47 -1.0 7.914899718008247 0.9746835443037974 0.0 0.5379746835443038 0.5411
A17C39N37 -7.96 -8.02 3.0 8.635208016283965 0.45569620253164556 0.5886075949367089 0.759493670886076 0.5392
A30C29N33 -7.65 -6.62 3.0 8.594987698306786 0.5189873417721519 0.5886075949367089 0.30379746835443033 0.5253
A94C10N1 -7.72 -8.18 0.0 8.348798703294651 0.8607594936708861 0.02531645569620253 0.810126582278481 0.5215
A70C39S -7.89 -7.7 3.0 8.652641732984252 0.430379746835443 0.5886075949367089 0.639240506329114 0.5146
A30C14N42 -7.01 -5.58 3.0 8.58511126631382 0.5443037974683544 0.5886075949367089 0.03797468354430378 0.5114
A18C43N46 -8.22 -7.54 3.0 8.65919698195674 0.4177215189873418 0.5886075949367089 0.5822784810126582 0.5025
A14C29N1 -7.5 -7.71 1.0 8.405097857478948 0.7848101265822784 0.10126582278481013 0.6645569620253164 0.4994
A9C18N48 -9.51 -6.5 3.0 8.641113873556971 0.44303797468354433 0.5886075949367089 0.26582278481012656 0.4835
A94C9N55 -7.53 -7.47 3.0 8.704128637597279 0.379746835443038 0.5886075949367089 0.5379746835443038 0.4791
A89C43N17 -7.36 -8.11 3.0 8.766152314954692 0.31645569620253167 0.5886075949367089 0.7848101265822784 0.4722
A96C9N36 -8.34 -7.48 3.0 8.713600822061995 0.35443037974683544 0.5886075949367089 0.5569620253164558 0.4684
A10C27N29 -8.42 -6.67 3.0 8.696989514674648 0.3924050632911392 0.5886075949367089 0.31645569620253167 0.4633
A91C32N36 -8.1 -6.73 3.0 8.705461826823583 0.36708860759493667 0.5886075949367089 0.3417721518987342 0.4532
A86C14N42 -7.93 -9.38 3.0 9.004306308098936 0.240506329113924 0.5886075949367089 0.9367088607594937 0.4494
A34C29N26 -8.76 -7.09 3.0 8.755804937568925 0.3291139240506329 0.5886075949367089 0.4683544303797469 0.4468
A47C29N5 -7.78 -8.0 1.0 8.511751247414363 0.6329113924050633 0.10126582278481013 0.7468354430379747 0.4316
A47C35N33 -8.66 -7.24 3.0 8.777982045548338 0.2911392405063291 0.5886075949367089 0.49367088607594933 0.4304
A56C15N37 -8.18 -9.85 3.0 9.213203885874382 0.189873417721519 0.5886075949367089 0.9873417721518988 0.4291
A48C39N14 -7.78 -9.32 3.0 9.179799621518226 0.20253164556962022 0.5886075949367089 0.9113924050632911 0.4278
A17C26N32 -9.34 -6.38 3.0 8.728999117353464 0.3417721518987342 0.5886075949367089 0.20253164556962022 0.4266
A51C43N18 -7.44 -6.72 2.0 8.503849330213104 0.6455696202531646 0.17721518987341772 0.3291139240506329 0.4266
A67C43N36 -7.09 -6.54 0.0 8.444062541206003 0.7341772151898734 0.02531645569620253 0.2784810126582279 0.4051
A47C7N5 -7.5 -5.13 3.0 8.774522145176395 0.30379746835443033 0.5886075949367089 0.012658227848101222 0.3886
A8C2N27 -7.46 -7.68 3.0 9.300461589845364 0.17721518987341767 0.5886075949367089 0.620253164556962 0.3861
A38C12N18 -7.3 -6.38 3.0 8.862395797191255 0.25316455696202533 0.5886075949367089 0.20253164556962022 0.3823
A47C29N51 -7.89 -7.7 3.0 9.371875917936864 0.16455696202531644 0.5886075949367089 0.639240506329114 0.3816
A45C3N42 -8.3 -5.65 1.0 8.503689991337597 0.6582278481012658 0.10126582278481013 0.05063291139240511 0.3747
A10C29N40 -7.98 -7.55 1.0 8.588694139570599 0.5316455696202531 0.10126582278481013 0.5949367088607596 0.3658
A45C43N59 -8.3 -6.27 3.0 9.13443746786742 0.21518987341772156 0.5886075949367089 0.17721518987341767 0.3608
A9C12N48 -9.37 -7.29 2.0 8.62156047919374 0.4683544303797469 0.17721518987341772 0.5063291139240507 0.3557
A100C26N33 -8.03 -7.13 3.0 9.470377719907413 0.1392405063291139 0.5886075949367089 0.4810126582278481 0.3532
A11C24N3 -7.73 -5.08 3.0 9.005910632282308 0.22784810126582278 0.5886075949367089 0.0 0.3494
A9C26N40 -8.09 -7.59 3.0 9.94311537023122 0.10126582278481011 0.5886075949367089 0.6075949367088608 0.3468
A92C8N24 -8.76 -7.43 3.0 9.651640083816794 0.11392405063291144 0.5886075949367089 0.5189873417721519 0.3443
A17C9N19 -8.48 -7.74 3.0 10.198161860536729 0.07594936708860756 0.5886075949367089 0.6962025316455696 0.343
A89C27N40 -6.94 -9.54 1.0 8.688204147252986 0.40506329113924056 0.10126582278481013 0.9746835443037974 0.3405
A34C9N34 -8.79 -11.23 3.0 13.15777898505314 0.0 0.5886075949367089 1.0 0.3354
A34C8N55 -8.0 -7.8 3.0 10.265816438150202 0.05063291139240511 0.5886075949367089 0.7088607594936709 0.3316
A45C12N3 -8.71 -6.16 3.0 9.421099640561394 0.15189873417721522 0.5886075949367089 0.15189873417721522 0.3266
A96C12N59 -8.3 -6.39 3.0 9.580293818824217 0.12658227848101267 0.5886075949367089 0.22784810126582278 0.3215
A10C9N19 -8.07 -7.71 3.0 12.434354548967008 0.012658227848101222 0.5886075949367089 0.6645569620253164 0.3082
A9C19N14 -7.71 -7.04 1.0 8.824637850513131 0.26582278481012656 0.10126582278481013 0.42405063291139244 0.2158
A73C12N17 -9.7 -9.05 2.0 10.655115425644947 0.025316455696202556 0.17721518987341772 0.8987341772151899 0.1734
A13C37S -7.89 -5.9 0.0 8.797159208570527 0.2784810126582279 0.02531645569620253 0.08860759493670889 0.1582
A34C8N36 -7.96 -8.17 1.0 10.200958789228768 0.06329113924050633 0.10126582278481013 0.7974683544303798 0.1519
A64C43N19 -8.26 -8.98 1.0 10.400293339046502 0.03797468354430378 0.10126582278481013 0.8860759493670887 0.1481
A17C12N34 -9.22 -6.08 1.0 9.959145515027332 0.08860759493670889 0.10126582278481013 0.10126582278481011 0.0949
"""
